"""Continuous periods and gaps of overlapping intervals, per entity.

The state of an entity is an ordered map of disjoint intervals: an insertion finds what it overlaps or touches by binary
search and merges it; the gaps are what lies between neighbours. The state is kept per (entity, time slot), a slot being
SLOT_MS long, so that it is bounded (at most SLOT_MS / 2 disjoint intervals) however many rows one entity has:

1. before the shuffle each task keeps partial maps of its rows and sends on only their disjoint intervals;
2. each slot inserts these into its map, knowing how far all earlier slots of the entity reach (one number);
3. what crosses slots (the slot's last period, and what earlier periods absorb) is put together from at most two rows a
   slot in a window over the entity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import shipped

SLOT_MS = 1_800_000
FLUSH = 200_000


class IntervalMap:
    """Ordered disjoint intervals with the number of insertions each is made of; touching intervals merge."""

    __slots__ = ("starts", "ends", "counts")

    def __init__(self):
        self.starts, self.ends, self.counts = [], [], []

    def __len__(self) -> int:
        return len(self.starts)

    def insert(self, start: int, end: int, count: int = 1) -> int:
        """Inserts [start, end]; returns by how many intervals the map has grown."""
        starts, ends = self.starts, self.ends
        i = bisect_left(ends, start)
        if i == len(ends):
            starts.append(start), ends.append(end), self.counts.append(count)
            return 1
        j = bisect_right(starts, end, i)
        if i == j:
            starts.insert(i, start), ends.insert(i, end), self.counts.insert(i, count)
            return 1
        if j == i + 1:
            if start < starts[i]:
                starts[i] = start
            if end > ends[i]:
                ends[i] = end
            self.counts[i] += count
            return 0
        starts[i:j] = [min(start, starts[i])]
        ends[i:j] = [max(end, ends[j - 1])]
        self.counts[i:j] = [count + sum(self.counts[i:j])]
        return 1 - (j - i)

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:], strict=True))


_PARTIAL = pa.schema([("record_id", pa.int64()), ("slot", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("n", pa.int64())])
_OUT = pa.schema(
    [("record_id", pa.int64()), ("slot", pa.int64()), ("own", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("n", pa.int64())]
)


def _combine(slot_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], IntervalMap] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            cols: list[list[int]] = [[], [], [], [], []]
            for (rid, slot), m in state.items():
                k = len(m)
                cols[0] += [rid] * k
                cols[1] += [slot] * k
                cols[2] += m.starts
                cols[3] += m.ends
                cols[4] += m.counts
            state.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PARTIAL)

        for b in batches:
            for rid, s, e in zip(*(b.column(x).to_pylist() for x in ("record_id", "s", "e")), strict=True):
                key = (rid, s // slot_ms)
                m = state.get(key)
                if m is None:
                    m = state[key] = IntervalMap()
                size += m.insert(s, e)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if state:
            yield flush()

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (record_id, slot): inserts them and emits what the slot settles, and its edges.

    kind 'merged', 'gap': final. kind 'more' (seq 0): what an earlier period absorbs; kind 'open' (seq 1): the slot's
    last period, which may go on. own is the slot for final rows and NULL for edges.
    """
    out: list[list] = [[] for _ in _OUT]

    def put(*row) -> None:
        for c, v in zip(out, row, strict=True):
            c.append(v)

    def close(rid: int, slot: int, m: IntervalMap, reach: int | None) -> None:
        i, k = 0, len(m)
        if reach is not None:
            i = bisect_right(m.starts, reach)
            if i:
                put(rid, slot, None, 0, "more", m.starts[0], m.ends[i - 1], sum(m.counts[:i]))
                reach = max(reach, m.ends[i - 1])
                # an absorbed interval may reach over the next ones
                while i < k and m.starts[i] <= reach:
                    put(rid, slot, None, 0, "more", m.starts[i], m.ends[i], m.counts[i])
                    reach = max(reach, m.ends[i])
                    i += 1
        for j in range(i, k):
            if reach is not None:
                put(rid, slot, slot, 0, "gap", reach, m.starts[j], 0)
            reach = m.ends[j]
            if j < k - 1:
                if m.counts[j] > 1:
                    put(rid, slot, slot, 0, "merged", m.starts[j], m.ends[j], m.counts[j])
            else:
                put(rid, slot, None, 1, "open", m.starts[j], m.ends[j], m.counts[j])

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _OUT, strict=True)], schema=_OUT)
        for c in out:
            c.clear()
        return b

    key, m, reach = None, IntervalMap(), None
    for b in batches:
        for rid, slot, s, e, n in zip(*(b.column(x).to_pylist() for x in ("record_id", "slot", "s", "e", "n")), strict=True):
            if key != (rid, slot):
                if key is not None:
                    close(*key, m, reach)
                    if len(out[0]) >= 20_000:
                        yield batch()
                key, m, reach = (rid, slot), IntervalMap(), None
            if n == 0:
                reach = e
            else:
                m.insert(s, e, n)
    if key is not None:
        close(*key, m, reach)
    if out[0]:
        yield batch()


def periods_and_gaps(intervals: DataFrame, max_gap_ms: int = 3_600_000, slot_ms: int = SLOT_MS) -> DataFrame:
    """Periods made of two or more intervals, and the gaps between consecutive periods of an entity.

    intervals: record_id bigint, s bigint, e bigint (milliseconds), each interval once, s < e, no NULL. Other rows must
    be filtered before. Result: record_id, kind ('merged' or 'gap'), start_ms, end_ms. Touching intervals belong to one
    period. A gap longer than max_gap_ms is not reported. Empty input gives no row.
    """
    base = shipped(intervals.select("record_id", "s", "e"))
    slots = base.groupBy("record_id", F.floor(F.col("s") / slot_ms).alias("slot")).agg(F.max("e").alias("top"))
    before = W.partitionBy("record_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    reach = slots.select("record_id", "slot", F.lit(None).cast("bigint").alias("s"), F.max("top").over(before).alias("e"), F.lit(0).cast("bigint").alias("n")).where(F.col("e").isNotNull())
    partial = base.mapInArrow(_combine(slot_ms), "record_id bigint, slot bigint, s bigint, e bigint, n bigint")
    rows = partial.unionByName(reach).repartition("record_id", "slot").sortWithinPartitions("record_id", "slot", "s")
    settled = rows.mapInArrow(_settle, "record_id bigint, slot bigint, own bigint, seq int, kind string, s bigint, e bigint, n bigint")
    w = W.partitionBy("record_id", "own")
    grouped = settled.withColumn("_g", F.sum((F.col("kind") == "open").cast("int")).over(w.orderBy("slot", "seq", "s").rowsBetween(W.unboundedPreceding, 0)))
    edge = F.col("own").isNull()
    g = W.partitionBy("record_id", "own", "_g")
    whole = grouped.withColumn("_e", F.when(edge, F.max("e").over(g)).otherwise(F.col("e"))).withColumn("_n", F.when(edge, F.sum("n").over(g)).otherwise(F.col("n")))
    keep = ((F.col("kind") == "merged") | ((F.col("kind") == "open") & (F.col("_n") > 1))) | (
        (F.col("kind") == "gap") & (F.col("e") - F.col("s") <= max_gap_ms)
    )
    kind = F.when(F.col("kind") == "gap", "gap").otherwise("merged")
    return whole.where(keep).select("record_id", kind.alias("kind"), F.col("s").alias("start_ms"), F.col("_e").alias("end_ms"))
