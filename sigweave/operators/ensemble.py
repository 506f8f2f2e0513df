"""Ensembles: time-aligned rows in long form (row keys, k, v), k the position on the common grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def missing(v: Column) -> Column:
    """v with NaN as NULL."""
    return F.nanvl(v.cast("double"), F.lit(None).cast("double"))


def long_rows(rows: DataFrame, keys: Sequence[str], values: str = "values") -> DataFrame:
    """(keys, k, v) of array rows."""
    return rows.select(*keys, F.posexplode(values).alias("k", "v")).select(*keys, F.col("k").cast("bigint").alias("k"), F.col("v").cast("double").alias("v"))


def statistics(ens: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Per grid position over all rows: NaN-ignoring mean, median, std, var (population), cv, eta2 and NaN-keeping average.

    One partial + final aggregation by k; cv and eta2 of a zero mean are NULL. The median is exact, with a buffer of the
    position's distinct values; accuracy makes it a sketch of that size for ensembles too large for it.
    """
    v = missing(F.col("v"))
    m, s, q = F.avg(v), F.stddev_pop(v), F.var_pop(v)
    return ens.groupBy("k").agg(
        m.alias("mean"), (F.percentile_approx(v, 0.5, accuracy) if accuracy else F.percentile(v, F.lit(0.5))).alias("median"), s.alias("std"), q.alias("var"), F.avg("v").alias("average"), F.try_divide(s, m).alias("cv"), F.try_divide(q, m * m).alias("eta2")
    )


def normalize(rows: DataFrame, values: str = "values", method: str = "meanstd", alpha: float = 0.0, beta: float = 1.0) -> DataFrame:
    """Each row (v - alpha * mean) / std ** beta over itself (meanstd: 1 and 1); zero spread gives NULLs, NaN spreads to its row."""
    a, b = (1.0, 1.0) if method == "meanstd" else (alpha, beta)
    x = F.transform(values, lambda v: v.cast("double"))
    n = F.size(x)
    # per-row statistics go into lambdas as repeated arrays: written out there, they would be taken again for each value
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    mean = F.try_divide(total(x), n)
    spread = F.sqrt(F.try_divide(total(F.zip_with(x, F.array_repeat(mean, n), lambda v, m: (v - m) * (v - m))), n))
    stat = F.array_repeat(F.struct(mean.alias("m"), F.pow(spread, F.lit(b)).alias("s")), n)
    return rows.withColumn(values, F.zip_with(x, stat, lambda v, st: F.try_divide(v - a * st["m"], st["s"])))


def nan_remove(rows: DataFrame, values: str = "values") -> DataFrame:
    """Rows without any NaN or NULL value."""
    return rows.where(~F.exists(values, lambda v: v.isNull() | F.isnan(v)))


def sort_rows(rows: DataFrame, by: str, ascending: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """By a column, NULLs last either way; a range-partitioned sort."""
    c = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return rows.orderBy(c, *tie)


def vstack(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; columns by name, missing ones NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def rows_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have; NULLs are alike."""
    return a.intersect(b)


def rows_only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a without as many equal ones as b has; NULLs are alike."""
    return a.exceptAll(b)


def first_row(rows: DataFrame, where: str | Column, order: Sequence[str]) -> DataFrame:
    """The first of the rows that match, by order."""
    return rows.where(where).orderBy(*order).limit(1)


def hstack(a: DataFrame, b: DataFrame, keys: Sequence[str], overlap: int = 0, values: str = "values") -> DataFrame:
    """b's values after a's, row by row; over overlap positions they cross-fade linearly, b's weight being (m + 1/n) spaced 1/n to 1.

    The weight of b at the m-th of n shared positions is 1/n + m * (1 - 1/n) / n. Rows without partner are left out.
    """
    j = a.select(*keys, F.col(values).alias("_a")).join(b.select(*keys, F.col(values).alias("_b")), list(keys))
    n = overlap
    if not n:
        return j.select(*keys, F.concat("_a", "_b").alias(values))
    head = F.slice("_a", F.lit(1), F.size("_a") - n)
    tail = F.slice("_b", F.lit(n + 1), F.greatest(F.size("_b") - n, F.lit(0)))
    pairs = F.zip_with(F.slice("_a", F.size("_a") - n + 1, F.lit(n)), F.slice("_b", F.lit(1), F.lit(n)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    mixed = F.transform(pairs, lambda p, m: p["x"] * (1 - (1.0 / n + m * ((1 - 1.0 / n) / n))) + p["y"] * (1.0 / n + m * ((1 - 1.0 / n) / n)))
    return j.select(*keys, F.concat(head, mixed, tail).alias(values))


def add(a: DataFrame, b: DataFrame, keys: Sequence[str], offset: int = 0, sign: int = 1) -> DataFrame:
    """a + sign * b over the extent of both, b shifted by offset positions, 0 where one has no value."""
    bb = b.select(*keys, (F.col("k") + offset).alias("k"), F.col("v").alias("_b"))
    j = a.select(*keys, "k", F.col("v").alias("_a")).join(bb, [*keys, "k"], "full")
    return j.select(*keys, "k", (F.coalesce("_a", F.lit(0.0)) + sign * F.coalesce("_b", F.lit(0.0))).alias("v"))


def sample(rows: DataFrame, n: int, seed: int = 0, replace: bool = False, order: Sequence[str] = ()) -> DataFrame:
    """n rows at random by seed, with or without replacement (without: at most all).

    Without replacement it is a top-n by random number. With it, n draws of positions meet the rows, numbered in the order
    of a hash over chunks of hashes, so no task holds them all.
    """
    if not replace:
        return rows.orderBy(F.rand(seed), *order).limit(n)
    from .ordered import number_rows

    one = rows.withColumn("_all", F.lit(0)).withColumn("_h", F.xxhash64(*(order or rows.columns)))
    numbered = number_rows(one, ["_all"], ["_h", *order], "_at", F.shiftright("_h", 48)).drop("_h")
    total = rows.select(F.count("*")).scalar()
    draws = rows.sparkSession.range(n).select(F.floor(F.rand(seed) * total).cast("bigint").alias("_at"), F.col("id").alias("draw"))
    return draws.join(numbered, "_at").drop("_at", "_all")


def zeros(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of zeros on a grid of n positions: keys, k, v."""
    from .signals import positions

    return positions(rows.select(*keys).distinct(), keys, F.lit(n)).select(*keys, F.col("i").alias("k"), F.lit(0.0).alias("v"))


def build(cropped: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Crops (keys, k, v) onto the grid of the longest one, 0 where a row ends before it."""
    top = cropped.select(F.coalesce(F.max("k"), F.lit(0)).cast("bigint")).scalar()
    rows = cropped.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), top)).alias("k"))
    return rows.join(cropped, [*keys, "k"], "left").select(*keys, "k", F.coalesce("v", F.lit(0.0)).alias("v"))


def dejitter(ens: DataFrame, keys: Sequence[str], max_lag: int, iterations: int = 1) -> DataFrame:
    """Rows rolled (circularly) to the lag within max_lag at which they correlate best with the median trace; iterated.

    A round: medians by position (one small row a position); of every row and lag the Pearson correlation of the median
    with the row shifted against it, positions that a shifted row does not have counting as zeros, by an equi-join on
    position; best lag a row (least |lag| on ties). Rounds are cut by a checkpoint and stop when nothing moves.
    """
    out = ens
    for _ in range(iterations):
        med = out.groupBy("k").agg(F.percentile(missing(F.col("v")), F.lit(0.5)).alias("m"))
        # of the median as a template: its mean, spread and length
        t = med.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count("*").alias("n"), F.max("k").alias("top")).first()  # four numbers
        if t.top is None:
            break
        lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
        shifted = out.select(*keys, "k", "v", lags).withColumn("k", F.col("k") + F.col("lag"))
        z = F.when(F.lit((t.std or 0.0) > 1e-12), (F.col("m") - t.mean) / F.lit(t.std or 1.0)).otherwise(F.lit(0.0))
        v = F.col("v")
        sums = shifted.join(med, "k").groupBy(*keys, "lag").agg(F.sum(v * z).alias("dot"), F.sum(v).alias("s1"), F.sum(v * v).alias("s2"))
        var = t.n * F.col("s2") - F.col("s1") * F.col("s1")
        score = F.when(var > 1e-9, F.col("dot") / F.sqrt(F.greatest(var, F.lit(1e-300))))
        best = sums.groupBy(*keys).agg(F.max(F.struct(score.alias("score"), (-F.abs("lag")).alias("a"), "lag")).alias("b")).select(*keys, F.when(F.col("b.score").isNotNull(), F.col("b.lag")).otherwise(0).alias("lag"))
        moved = out.join(best, list(keys)).withColumn("k", F.pmod(F.col("k") + F.col("lag"), F.lit(t.top + 1)))
        moved = checkpointed(moved)
        out = moved.select(*keys, "k", "v")
        if moved.where("lag <> 0").limit(1).count() == 0:
            break
    return out
