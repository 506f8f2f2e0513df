"""Ordered operations on long signals without a task that holds a whole signal.

A key may own a third of all rows, so a window over the key alone is not used on samples. The order is cut into chunks;
windows run inside a chunk, and what crosses chunks is carried by one summary row a chunk (numbers, last values) or by a
halo of copied border rows (lag, lead, frames).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import carry_forward, checkpointed, shipped  # noqa: F401  (part of this module's surface)

CHUNK = 4096
#: Rows of a task that are packed together before a shuffle, and samples of a part at most.
PACKED, PART = 1 << 19, 1 << 16


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str, chunk: Column, scan: bool = False) -> DataFrame:
    """Adds out: 0-based position within keys by order. chunk must be monotone in order (ties of chunk ordered inside).

    Order should be total; rows that tie on all of it get consecutive numbers in an arbitrary order. NULL chunks come
    first, as NULLs do in the order. scan: df is a plain scan, cheaper to read twice (once for the chunks' sizes) than to
    shuffle again; otherwise df is computed once, and the offsets go along one row a chunk, as in carry_forward.
    """
    # _c makes NULL chunks a key
    cut = df.withColumn("_chunk", chunk).withColumn("_c", F.coalesce(F.col("_chunk").cast("string"), F.lit("")))
    inner = W.partitionBy(*keys, "_c").orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(inner))
    if scan:
        sizes = cut.groupBy(*keys, "_c").agg(F.max("_chunk").alias("_chunk"), F.count("*").alias("_n"))
        base = F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
        offsets = sizes.select(*keys, "_c", base.alias("_base")).where(F.col("_base").isNotNull())
        placed = local.join(offsets, [*keys, "_c"], "left")
    else:
        return running_sum(df, keys, order, F.lit(1).cast("bigint"), out, chunk)
    return placed.select(*df.columns, (F.coalesce("_base", F.lit(0)) + F.col("_rn") - 1).cast("bigint").alias(out))


def _pack(cols: list[np.ndarray]) -> bytes:
    """Columns of 8-byte numbers, the bytes of equal weight side by side, compressed."""
    a = np.stack([c.view(np.int64) for c in cols])
    a[0, 1:] -= a[0, :-1].copy()
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1, 8).transpose(0, 2, 1)), asbytes=True)


def _unpack(packed: bytes, n: int, dtypes: Sequence[np.dtype]) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(packed, n * 8 * len(dtypes), asbytes=True), np.uint8)
    a = raw.reshape(len(dtypes), 8, n).transpose(0, 2, 1).copy().view(np.int64)[:, :, 0]
    a[0] = np.cumsum(a[0])
    return [c.view(t) for c, t in zip(a, dtypes, strict=True)]


def parts_of_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], values: Callable[..., Sequence[np.ndarray]], width: int, chunk: Column) -> DataFrame:
    """Array parts (keys, first, samples, n) of a chunk's samples or less: the signals whose samples are width values a row,
    rows by order. n is the length of the signal.

    values: arrays of columns (doubles, NULL as NaN) to width arrays. order and columns are numbers, NULLs come first;
    rows that tie on order go by columns, so the result is deterministic. chunk is a bigint as in number_rows, and df a
    plain scan, which is read twice. Rows go packed and compressed through the one shuffle; a chunk must fit a task.
    """
    types = dict(df.dtypes)
    names = list(dict.fromkeys([*order, *columns]))
    floats = {c: types[c] in ("double", "float") or c not in order for c in names}
    dtypes = [np.dtype(np.float64 if floats[c] else np.int64) for c in names]
    n_keys, ddl = len(keys), "".join(f"`{k}` {types[k]}, " for k in keys)
    cut = df.select(*keys, chunk.cast("bigint").alias("_chunk"), *names)
    present = F.lit(0).cast("bigint")
    for j, c in enumerate(names):
        present = present + F.when(F.col(c).isNotNull(), F.lit(1 << j)).otherwise(F.lit(0))
    rows = cut.select(*keys, "_chunk", *[F.coalesce(F.col(c).cast("double" if floats[c] else "bigint"), F.lit(0)).alias(c) for c in names], present.alias("_present"))

    def packed(batches):
        t = pa.Table.from_batches(batches).combine_chunks()
        codes = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in range(n_keys + 1)]
        cols = [t.column(n_keys + 1 + k).to_numpy() for k in range(len(names) + 1)]
        by = np.lexsort([cols[0], *codes])
        new = np.zeros(len(by), bool)
        new[:1] = True
        for c in codes:
            new[1:] |= np.diff(c[by]) != 0
        at = [*np.flatnonzero(new).tolist(), len(by)]
        cols = [c[by] for c in cols]
        heads = t.select(range(n_keys + 1)).take(pa.array(by[at[:-1]])).combine_chunks()
        blobs = [_pack([c[a:b] for c in cols]) for a, b in zip(at, at[1:], strict=False)]
        return pa.RecordBatch.from_arrays([*(heads.column(k).combine_chunks() for k in range(n_keys + 1)), pa.array(np.diff(at), pa.int64()), pa.array(blobs, pa.binary())], names=[*keys, "_chunk", "n", "packed"])

    def pack(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def place(key, t):
        base, total, parts = 0, 0, []
        for n, blob, b in zip(*(t.column(c).to_pylist() for c in ("n", "packed", "base")), strict=True):
            if blob is None:
                base, total = b, n
            else:
                parts.append(_unpack(blob, n, [*dtypes, np.dtype(np.int64)]))
        *cols, there = [np.concatenate(c) for c in zip(*parts, strict=True)]
        del parts
        # order first, then the other columns; of each, NULLs before values
        if (there == (1 << len(names)) - 1).all():
            by = np.lexsort(cols[::-1])
            got = {c: a[by] for c, a in zip(names, cols, strict=True) if c in columns}
        else:
            by = np.lexsort([x for j, c in enumerate(cols) for x in ((there >> j) & 1, c)][::-1])
            got = {c: np.where((there >> j) & 1 == 1, a, np.nan)[by] for j, (c, a) in enumerate(zip(names, cols, strict=True)) if c in columns}
        del cols, there, by
        samples = np.stack([np.asarray(v, float) for v in values(*(got[c] for c in columns))], axis=1).ravel()
        at = np.arange(0, len(samples), PART)
        lists = pa.ListArray.from_arrays(pa.array([*at.tolist(), len(samples)], pa.int32()), pa.array(samples))
        return pa.table([*(pa.array([k.as_py()] * len(at), k.type) for k in key[:n_keys]), pa.array(base * width + at, pa.int64()), lists, pa.array([total * width] * len(at), pa.int64())], names=[*keys, "first", "samples", "n"])

    sizes = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    bases = sizes.select(*keys, "_chunk", F.sum("_n").over(W.partitionBy(*keys)).alias("n"), F.lit(None).cast("binary").alias("packed"), base.alias("base"))
    sent = shipped(rows).mapInArrow(pack, ddl + "_chunk bigint, n bigint, packed binary").withColumn("base", F.lit(None).cast("bigint"))
    return sent.unionByName(bases).groupBy(*keys, "_chunk").applyInArrow(place, ddl + "first bigint, samples array<double>, n bigint")


def number_all(df: DataFrame, order: Sequence[str | Column], out: str, first: int = 0) -> DataFrame:
    """Adds out: first, first + 1, ... by order over all rows, whatever their values: a range-partitioned sort.

    Rows are kept by a checkpoint between the sort and the count of its partitions, whose sizes (a number each) go
    through the driver, so a repeated task cannot see another cut. order should be total.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = checkpointed(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = {r[0]: r[1] for r in placed.groupBy("_part").count().collect()}
    offsets, at = [], first
    for k in range(max(sizes, default=-1) + 1):
        offsets.append(at)
        at += sizes.get(k, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in offsets or [0]]), F.col("_part") + 1)
    return placed.select(*df.columns, (base + F.col("_at")).alias(out))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, out: str, chunk: Column) -> DataFrame:
    """Adds out: the sum of value over the rows of keys that come before in order; chunk as in number_rows."""
    cut = df.withColumn("_chunk", chunk).withColumn("_c", F.coalesce(F.col("_chunk").cast("string"), F.lit(""))).withColumn("_amount", value)
    inner = W.partitionBy(*keys, "_c").orderBy(*order)
    local = cut.withColumn("_upto", F.sum("_amount").over(inner.rowsBetween(W.unboundedPreceding, 0))).withColumn("_last", F.lead(F.lit(True)).over(inner).isNull())
    along = W.partitionBy(*keys, F.when(~F.col("_last"), F.col("_c"))).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    placed = local.withColumn("_base", F.when(F.col("_last"), F.sum("_upto").over(along)))
    placed = placed.withColumn("_base", F.max("_base").over(W.partitionBy(*keys, "_c")))
    return placed.select(*df.columns, (F.coalesce("_base", F.lit(0)) + F.col("_upto") - F.col("_amount")).alias(out))


def with_halo(df: DataFrame, keys: Sequence[str], order: str, before: int, after: int, chunk: int = CHUNK) -> tuple[DataFrame, W]:
    """df with chunk numbers and copies of border rows, and the window spec (per keys and chunk, by order).

    Inside the spec each own row sees its before predecessors and after successors. Drop the copies with own_rows.
    order is an integer position.
    """
    i = F.col(order)
    first, last = F.floor((i - after) / chunk), F.floor((i + before) / chunk)
    home = F.floor(i / chunk)
    out = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.sequence(first, last)))
    return out, W.partitionBy(*keys, "_chunk").orderBy(order)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def blocks(samples: DataFrame, keys: Sequence[str], value: str = "v", order: str = "i", size: int | Column = 1 << 16, halo: int = 0, after: int | None = None) -> DataFrame:
    """Samples as array rows of bounded length: keys, block, i0 (position of the first value), own0, own_n, x.

    A block holds at most size values and halo before and after them (after, if given, behind them); own0 and own_n tell
    which are its own. A signal shorter than size is one block. size may be a column that is the same within a key.
    Positions must be complete (0 .. n-1); NULL values become NaN. Signals may also come as array parts (keys, first,
    samples), as sources give them: see blocks_of_parts.
    """
    if "samples" in samples.columns:
        return blocks_of_parts(samples, keys, size, halo, halo if after is None else after)
    i, size = F.col(order), size if isinstance(size, Column) else F.lit(size)
    after = halo if after is None else after
    out = samples.withColumn("_home", F.floor(i / size))
    if halo or after:
        # what a block has behind it lies in the heads of the next ones: a sample goes back to them by after, on by halo
        out = out.withColumn("block", F.explode(F.sequence(F.floor(F.greatest(i - after, F.lit(0)) / size), F.floor((i + halo) / size))))
        # a halo may reach a block that does not exist
        out = out.withColumn("_own", F.col("_home") == F.col("block"))
    else:
        out = out.withColumn("block", F.col("_home")).withColumn("_own", F.lit(True))
    v = F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))
    g = out.groupBy(*keys, "block").agg(
        F.array_sort(F.collect_list(F.struct(i.alias("i"), v.alias("v")))).alias("_x"), F.min(F.when(F.col("_own"), i)).alias("_first"), F.sum(F.col("_own").cast("int")).alias("own_n")
    )
    return g.where(F.col("own_n") > 0).select(*keys, "block", F.col("_x")[0]["i"].alias("i0"), (F.col("_first") - F.col("_x")[0]["i"]).cast("int").alias("own0"), "own_n", F.transform("_x", lambda s: s["v"]).alias("x"))


def blocks_of_parts(parts: DataFrame, keys: Sequence[str], size: int | Column, halo: int, after: int) -> DataFrame:
    """blocks of array parts (keys, first, samples) of any length: parts are sliced, so no sample is a row anywhere."""
    size = size if isinstance(size, Column) else F.lit(size)
    first, n = F.col("first"), F.size("samples")
    each = parts.where(n > 0).select(*keys, "first", "samples", F.explode(F.sequence(F.floor(F.greatest(first - after, F.lit(0)) / size), F.floor((first + n - 1 + halo) / size))).alias("block"))
    start, stop = F.col("block") * size, (F.col("block") + 1) * size
    lo, hi = F.greatest(first, start - halo), F.least(first + n, stop + after)
    own = F.greatest(F.least(first + n, stop) - F.greatest(first, start), F.lit(0))
    piece = F.slice("samples", (lo - first + 1).cast("int"), (hi - lo).cast("int"))
    cut = each.where(lo < hi).select(*keys, "block", F.struct(lo.alias("at"), piece.alias("x")).alias("p"), own.alias("own"), start.alias("start"))
    g = cut.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("p")).alias("_p"), F.sum("own").cast("bigint").alias("own_n"), F.first("start").alias("_start")).where(F.col("own_n") > 0)
    x = F.transform(F.flatten(F.transform("_p", lambda q: q["x"])), lambda v: F.coalesce(v.cast("double"), F.lit(float("nan"))))
    i0 = F.col("_p")[0]["at"]
    return g.select(*keys, "block", i0.alias("i0"), F.greatest(F.col("_start") - i0, F.lit(0)).cast("int").alias("own0"), "own_n", x.alias("x"))


def explode_signal(signals: DataFrame, keys: Sequence[str], values: str = "samples") -> DataFrame:
    """(keys, i, v) of array rows, or of array parts with their first position."""
    first = F.col("first") if "first" in signals.columns else F.lit(0)
    return signals.select(*keys, first.alias("_first"), F.posexplode(values).alias("i", "v")).select(*keys, (F.col("_first") + F.col("i")).cast("bigint").alias("i"), "v")
