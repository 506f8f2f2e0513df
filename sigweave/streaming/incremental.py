"""Streams: incremental annotation of new records, and interval periods with keyed state."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import shipped
from ..operators.periods import IntervalMap


def augment(stream: DataFrame, annotate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Annotates what arrived since the last call and appends it to the parquet folder target, each batch once.

    The batch number is part of the path written, and a repeated batch overwrites its own part: a failure between write
    and checkpoint repeats nothing. Late records with small ids are not skipped: progress is by file, not by id.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_periods(stream: DataFrame, key: str = "record_id", longest_gap: int = 3_600_000, horizon: int | None = None):
    """Disjoint periods per entity, and the gaps between them, over a stream of (key, s, e): after each batch what changed.

    Output: key, op, kind, start_ms, end_ms, n. op '+' is a period (made of n intervals) or gap that holds from now on, '-'
    one that no longer does, because it grew, was absorbed or was filled; gaps longer than longest_gap are none. The
    ordered interval map is the key's state. With horizon (ms) what ended longer ago than that before the entity's latest
    end is final and leaves the state, which bounds it; an interval that reaches back into it comes out with op 'late' and
    changes nothing. Use with output mode update.
    """

    def rows(m: IntervalMap) -> set[tuple]:
        out = {("period", a, b, n) for a, b, n in zip(m.starts, m.ends, m.counts, strict=True)}
        return out | {("gap", a, b, 0) for a, b in m.gaps() if b - a <= longest_gap}

    def update(k: tuple, batches, state: GroupState):
        m, floor = IntervalMap(), None
        if state.exists:
            starts, ends, counts, floor = state.get
            m.starts, m.ends, m.counts = list(starts), list(ends), list(counts)
        before, late = rows(m), []
        for pdf in batches:
            for s, e in zip(pdf["s"], pdf["e"], strict=True):
                if floor is not None and s <= floor:
                    late.append(("late", "interval", int(s), int(e), 1))
                else:
                    m.insert(int(s), int(e))
        after = rows(m)
        if horizon is not None and m.ends:
            # a period stays while the gap behind it, or an interval within the horizon, may still concern it
            keep = bisect_left(m.ends, m.ends[-1] - horizon - longest_gap)
            if keep:
                floor = m.ends[keep - 1]
                m.starts, m.ends, m.counts = m.starts[keep:], m.ends[keep:], m.counts[keep:]
        state.update((m.starts, m.ends, m.counts, floor))
        out = [("-", *r) for r in sorted(before - after)] + [("+", *r) for r in sorted(after - before)] + late
        yield pd.DataFrame([(k[0], *r) for r in out], columns=[key, "op", "kind", "start_ms", "end_ms", "n"])

    return shipped(stream).groupBy(key).applyInPandasWithState(
        update, f"{key} bigint, op string, kind string, start_ms bigint, end_ms bigint, n bigint", "starts array<bigint>, ends array<bigint>, counts array<bigint>, floor bigint", "update", GroupStateTimeout.NoTimeout
    )
