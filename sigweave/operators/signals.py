"""Signals in long form (keys, i, v): one row a sample, everything in Catalyst expressions.

Time of sample i is delay + (i + tjust) / rate. Ordered neighbours come through halos (see ordered), lengths and sums
through partial aggregation, so a signal with a third of all samples is spread over tasks. NULL is a missing sample; NaN
counts as missing where an operator says so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key
from .ordered import CHUNK, number_rows, own_rows, with_halo


def times(i: Column, rate: float, delay: float = 0.0, tjust: float = 0.5) -> Column:
    return F.lit(delay) + (i + tjust) / F.lit(float(rate))


def lengths(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.count("*").alias("n"))


def with_totals(samples: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """samples, or array parts (keys, first, samples), with per-signal aggregates attached (n always), whatever the skew.

    Parts that have their signal's length n keep it.
    """
    parts = "samples" in samples.columns
    if parts and "n" in samples.columns and not aggs:
        return samples
    totals = samples.groupBy(*keys).agg((F.sum(F.size("samples")) if parts else F.count("*")).alias("n"), *[a.alias(n) for n, a in aggs.items()])
    return attach_by_key(samples, totals, keys, "n", all_of(totals, "n"), F.col("first" if parts else "i"))


def all_of(totals: DataFrame, column: str) -> Column:
    """Sum of a per-signal count over all signals, as a scalar subquery: no job runs while a plan is built."""
    return totals.select(F.coalesce(F.sum(column), F.lit(0))).scalar()


def crop_bounds(n: Column, start: float | None, end: float | None, rate: float, delay: float = 0.0, samples: int | None = None) -> tuple[Column, Column]:
    """First and past-the-last index of a crop by exactly two of start, end, samples."""
    if sum(x is not None for x in (start, end, samples)) != 2:
        raise ValueError("exactly two of start, end and samples")
    if start is not None:
        i0 = F.greatest(F.lit(0), F.floor((F.lit(start) - delay) * rate)).cast("bigint")
        i1 = F.least(n, F.floor((F.lit(end) - delay) * rate)).cast("bigint") if end is not None else F.least(n, i0 + samples)
    else:
        i1 = F.least(n, F.floor((F.lit(end) - delay) * rate)).cast("bigint")
        i0 = F.greatest(F.lit(0), i1 - samples)
    return i0, i1


def crop(samples: DataFrame, keys: Sequence[str], start: float, end: float, rate: float | Column = 1.0, delay: float | Column = 0.0) -> DataFrame:
    """Samples of [start, end): i stays the original position. Needs no length, so it is a filter without a shuffle.

    rate and delay may be columns, so the channels of a record are cut at one time whatever their own; a channel that has
    nothing there has no rows. Also cuts matrices in long form.
    """
    if isinstance(rate, Column) or isinstance(delay, Column):
        i0, i1 = (F.floor((F.lit(float(t)) - delay) * rate) for t in (start, end))
        return samples.where((F.col("i") >= F.greatest(F.lit(0), i0)) & (F.col("i") < i1))
    i0 = max(0, int((start - delay) * rate // 1))
    i1 = int((end - delay) * rate // 1)
    return samples.where((F.col("i") >= i0) & (F.col("i") < i1))


def clip(v: Column, low: float, high: float) -> Column:
    """Bounded value; NaN stays NaN, NULL stays NULL."""
    return F.when(F.isnan(v), v).otherwise(F.when(v < low, F.lit(low)).when(v > high, F.lit(high)).otherwise(v))


def reverse(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    out = with_totals(samples, keys)
    return out.withColumn("i", F.col("n") - 1 - F.col("i")).drop("n")


def normalize(samples: DataFrame, keys: Sequence[str], method: str = "absmax", alpha: float = 0.0, beta: float = 1.0) -> DataFrame:
    """absmax, meanstd or alphabeta ((v - alpha * mean) / std ** beta, population std); zero spread gives NULL.

    meanstd and alphabeta ignore NaN when they take mean and spread; absmax lets NaN through.
    """
    v, ok = F.col("v"), F.nanvl(F.col("v"), F.lit(None).cast("double"))
    if method == "absmax":
        out = with_totals(samples, keys, _top=F.max(F.abs(v)))
        return out.withColumn("v", F.try_divide(v, F.col("_top"))).drop("n", "_top")
    out = with_totals(samples, keys, _m=F.avg(ok), _s=F.stddev_pop(ok))
    a, b = (1.0, 1.0) if method == "meanstd" else (alpha, beta)
    return out.withColumn("v", F.try_divide(v - a * F.col("_m"), F.pow("_s", F.lit(b)))).drop("n", "_m", "_s")


def derivative(samples: DataFrame, keys: Sequence[str], rate: float = 1.0) -> DataFrame:
    """Central difference inside, one-sided at the ends; NULL for a signal of one sample."""
    h, w = with_halo(samples, keys, "i", 1, 1)
    p, n, v = F.lag("v").over(w), F.lead("v").over(w), F.col("v")
    d = F.coalesce((n - p) * rate / 2, (n - v) * rate, (v - p) * rate)
    return own_rows(h.withColumn("_d", d)).withColumn("v", F.col("_d")).drop("_d")


def teager(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """x[i]**2 - x[i-1] * x[i+1] at inner samples; i of the result starts at 0 (delay grows by one sample)."""
    h, w = with_halo(samples, keys, "i", 1, 1)
    h = h.withColumn("_t", F.col("v") * F.col("v") - F.lag("v").over(w) * F.lead("v").over(w))
    return own_rows(h).where(F.col("_t").isNotNull()).withColumn("v", F.col("_t")).withColumn("i", F.col("i") - 1).drop("_t")


def fir(samples: DataFrame, keys: Sequence[str], taps: Sequence[float]) -> DataFrame:
    """Causal FIR filter: zeros before the beginning."""
    h, w = with_halo(samples, keys, "i", len(taps) - 1, 0)
    y = sum((F.lit(float(b)) * F.coalesce(F.lag("v", k).over(w) if k else F.col("v"), F.lit(0.0)) for k, b in enumerate(taps)), F.lit(0.0))
    return own_rows(h.withColumn("_y", y)).withColumn("v", F.col("_y")).drop("_y")


def savgol_inner(samples: DataFrame, keys: Sequence[str], window: int = 7, order: int = 3) -> DataFrame:
    """Least-squares polynomial smoothing at samples with a full window; the borders are left out (see transforms.smooth)."""
    from ..functions.kernels import savgol_coefficients

    half = window // 2
    c = savgol_coefficients(window, order)
    h, w = with_halo(samples, keys, "i", half, half)
    y = sum((F.lit(float(c[k + half])) * (F.lead("v", k).over(w) if k > 0 else F.lag("v", -k).over(w) if k < 0 else F.col("v")) for k in range(-half, half + 1)), F.lit(0.0))
    return own_rows(h.withColumn("_y", y)).where(F.col("_y").isNotNull()).withColumn("v", F.col("_y")).drop("_y")


def bin_of(i: Column, n: Column, size: int) -> Column:
    """Bin of sample i when n samples fall into floor(n / size) nearly equal bins, the first n mod k one longer."""
    k = F.floor(n / size)
    q = F.floor(n / k)
    r = n - k * q
    return F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / q))


def bins(samples: DataFrame, keys: Sequence[str], size: int, agg: Column, repeat: int = 1) -> DataFrame:
    """Each bin's aggregate of v (agg refers to column v), each repeated repeat times; signals shorter than size have none."""
    b = with_totals(samples, keys).where(F.col("n") >= size)
    out = b.groupBy(*keys, bin_of(F.col("i"), F.col("n"), size).cast("bigint").alias("i")).agg(agg.alias("v"))
    if repeat > 1:
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("i", F.col("i") * repeat + F.col("_k")).drop("_k")
    return out


def extremum(samples: DataFrame, keys: Sequence[str], largest: bool = True, rate: float = 1.0, delay: float = 0.0, tjust: float = 0.5) -> DataFrame:
    """Time of the first greatest (or least) value; NaN and NULL ignored, a signal of nothing else gives NULL."""
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    key = F.when(v.isNotNull(), F.struct((v if largest else -v).alias("v"), (-F.col("i")).alias("i")))
    return samples.groupBy(*keys).agg(F.max(key).alias("_m")).select(*keys, times(-F.col("_m.i"), rate, delay, tjust).alias("time"))


def at_times(samples: DataFrame, points: DataFrame, keys: Sequence[str], rate: float = 1.0, delay: float = 0.0, tjust: float = 0.5, fill: float | None = 0.0, hold: bool = True) -> DataFrame:
    """Linear interpolation of uniform signals at points (keys, t): two index joins, no nearest-neighbour search.

    hold keeps the first and last value through their half samples; outside, fill (None: NULL). A point of an unknown
    signal gives fill. Points may hold further columns.
    """
    n = lengths(samples, keys)
    p = attach_by_key(points, n, keys, "n", all_of(n, "n"), F.col("t"), "left")
    k = (F.col("t") - delay) * rate - tjust
    last = (F.col("n") - 1).cast("double")
    lo = F.least(F.greatest(F.floor(k).cast("double"), F.lit(0.0)), last)
    p = p.withColumn("_lo", lo.cast("bigint")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("n") - 1)).withColumn("_f", F.least(F.greatest(k - F.col("_lo"), F.lit(0.0)), F.lit(1.0)))
    edge = (F.col("t") >= delay) & (F.col("t") <= delay + F.col("n") / rate) if hold else (k >= 0) & (k <= last)
    p = p.withColumn("_in", F.coalesce(edge, F.lit(False)))
    a = samples.select(*keys, F.col("i").alias("_lo"), F.col("v").alias("_a"))
    b = samples.select(*keys, F.col("i").alias("_hi"), F.col("v").alias("_b"))
    j = p.join(a, [*keys, "_lo"], "left").join(b, [*keys, "_hi"], "left")
    v = F.when(F.col("_in"), F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).otherwise(F.lit(fill).cast("double"))
    return j.select(*points.columns, v.alias("v"))


def positions(n: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """(keys, i): 0 .. count - 1 for each row of n. Chunks are dealt out before they are filled, so one long signal is many tasks."""
    starts = n.where(count > 0).select(*keys, count.cast("bigint").alias("_m")).select(*keys, "_m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1, F.lit(CHUNK).cast("bigint"))).alias("_c"))
    dealt = starts.repartition(*keys, "_c")
    return dealt.select(*keys, F.explode(F.sequence(F.col("_c"), F.least(F.col("_c") + CHUNK, F.col("_m")) - 1)).alias("i"))


def grid(samples: DataFrame, keys: Sequence[str], rate: float, new_rate: float) -> DataFrame:
    """Sample times of a resampled signal: keys, i, t (delay 0, tjust 0.5)."""
    return positions(lengths(samples, keys), keys, F.floor(F.col("n") * new_rate / rate)).withColumn("t", (F.col("i") + 0.5) / new_rate)


def resample(samples: DataFrame, keys: Sequence[str], rate: float, new_rate: float) -> DataFrame:
    """Linear resampling without anti-aliasing."""
    return at_times(samples, grid(samples, keys, rate, new_rate), keys, rate).select(*keys, "i", "v")


def pad(samples: DataFrame, keys: Sequence[str], before: int, after: int, fill: float | None = 0.0) -> DataFrame:
    """before and after fill samples added; i counts from the new beginning (delay shrinks by before samples)."""
    n = lengths(samples, keys)
    fills = n.select(*keys, F.explode(F.concat(F.sequence(F.lit(0).cast("bigint"), F.lit(before).cast("bigint") - 1) if before else F.array().cast("array<bigint>"), F.sequence(F.col("n") + before, F.col("n") + before + after - 1) if after else F.array().cast("array<bigint>"))).alias("i"))
    return samples.select(*keys, (F.col("i") + before).alias("i"), "v").unionByName(fills.withColumn("v", F.lit(fill).cast("double")))


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str], offset: Column | int = 0, op: str = "+", outer: bool = False, outside_null: bool = True) -> DataFrame:
    """a + b or a - b on a's grid; b's sample i lies at a's i + offset (signals of one rate).

    Missing partners: for '+' they add nothing and both missing gives NULL, for '-' they are 0. outer keeps the whole
    extent of both, with 0 for what one lacks.
    """
    o = F.lit(offset) if isinstance(offset, int) else offset
    bb = b.select(*keys, (F.col("i") + o).alias("i"), F.col("v").alias("_b"))
    j = a.select(*keys, "i", F.col("v").alias("_a")).join(bb, [*keys, "i"], "full" if outer else "left")
    x, y = F.nanvl(F.col("_a"), F.lit(None).cast("double")), F.nanvl(F.col("_b"), F.lit(None).cast("double"))
    z = F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * (1 if op == "+" else -1)
    v = F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(z) if op == "+" and outside_null else z
    return j.select(*keys, "i", v.alias("v"))


def combine_times(a: DataFrame, b: DataFrame, keys: Sequence[str], rate: float, rate_b: float, delay: float = 0.0, delay_b: float = 0.0, op: str = "+") -> DataFrame:
    """a + b or a - b at a's times, b (of its own rate and delay) interpolated there; missing partners as in combine."""
    points = a.select(*keys, "i", F.col("v").alias("_mine"), times(F.col("i"), rate, delay).alias("t"))
    j = at_times(b, points, keys, rate_b, delay_b, fill=None)
    x, y = F.nanvl(F.col("_mine"), F.lit(None).cast("double")), F.nanvl(F.col("v"), F.lit(None).cast("double"))
    z = F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)) * (1 if op == "+" else -1)
    return j.select(*keys, "i", (F.when(x.isNotNull() | y.isNotNull(), z) if op == "+" else z).alias("v"))


def create_grid(points: DataFrame, keys: Sequence[str], rate: float, chunk: float = 3600.0) -> DataFrame:
    """Irregular points (keys, t, v) to a regular grid: linear between neighbours.

    int((tmax - tmin) * rate) samples from tmin on. Points with equal t: the greatest v counts. Neighbours are found by
    numbering the points over chunks of chunk seconds, so no task sorts all points of a key. A key of one point has no grid.
    """
    one = points.groupBy(*keys, "t").agg(F.max("v").alias("v"))
    numbered = number_rows(one, keys, ["t"], "_i", F.floor(F.col("t") / chunk))
    h, w = with_halo(numbered, keys, "_i", 0, 1)
    seg = own_rows(h.withColumn("_t1", F.lead("t").over(w)).withColumn("_v1", F.lead("v").over(w))).where(F.col("_t1").isNotNull())
    span = points.groupBy(*keys).agg(F.min("t").alias("_first"), F.max("t").alias("_end"), F.count("*").alias("_weight"))
    seg = attach_by_key(seg, span, keys, "_weight", all_of(span, "_weight"), F.col("_i")).withColumn("_m", F.floor((F.col("_end") - F.col("_first")) * rate).cast("bigint"))
    lo = F.ceil((F.col("t") - F.col("_first")) * rate).cast("bigint")
    hi = F.least(F.ceil((F.col("_t1") - F.col("_first")) * rate).cast("bigint"), F.col("_m")) - 1
    cells = seg.withColumn("_lo", lo).withColumn("_hi", hi).where(F.col("_lo") <= F.col("_hi")).withColumn("i", F.explode(F.sequence("_lo", "_hi")))
    at = F.col("_first") + F.col("i") / rate
    slope = (F.col("_v1") - F.col("v")) / (F.col("_t1") - F.col("t"))
    return cells.select(*keys, "i", (F.col("v") + (at - F.col("t")) * slope).alias("v"))


def features(samples: DataFrame, keys: Sequence[str], rate: float = 1.0) -> DataFrame:
    """Scalar features of each signal in one pass: n, abs_sum, energy, rms, peak, mean, crossings need no second scan."""
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.abs(v)).alias("abs_sum"), (F.sum(v * v) / rate).alias("energy"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")
    )


def robust_threshold(samples: DataFrame, keys: Sequence[str], factor: float = 1.0, accuracy: int | None = None) -> DataFrame:
    """median + factor * 4 * median absolute deviation / 0.6745 of each signal.

    Exact medians keep a signal's distinct values in one buffer; accuracy switches to sketches of that size, for signals
    beyond an executor's memory.
    """
    v = F.nanvl(F.col("v"), F.lit(None).cast("double"))
    median = (lambda c: F.percentile_approx(c, 0.5, accuracy)) if accuracy else (lambda c: F.percentile(c, F.lit(0.5)))
    med = samples.groupBy(*keys).agg(median(v).alias("_med"), F.count("*").alias("n"))
    dev = attach_by_key(samples, med, keys, "n", all_of(med, "n"), F.col("i"))
    out = dev.groupBy(*keys).agg(F.first("_med").alias("median"), median(F.abs(v - F.col("_med"))).alias("mad"), F.count("*").alias("n"))
    return out.select(*keys, "n", "median", "mad", (F.col("median") + factor * 4 * F.col("mad") / 0.6745).alias("threshold"))


def annotation_samples(samples: DataFrame, annots: DataFrame, key: str = "rid", rate: float = 1.0, delay: float = 0.0) -> DataFrame:
    """Samples of each annotation: key, annot_id, k (position in it), v.

    Annotations meet arrays of CHUNK samples, by (key, chunk), and take their slice of each: the join has a row for each
    annotation and chunk, not for each sample, and no record's samples meet in one task.
    """
    i0 = F.greatest(F.lit(0), F.floor((F.col("start") - delay) * rate)).cast("bigint")
    i1 = F.floor((F.col("end") - delay) * rate).cast("bigint")
    a = annots.select(key, "annot_id", i0.alias("_i0"), i1.alias("_i1")).where(F.col("_i1") > F.col("_i0"))
    a = a.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("_i0") / CHUNK), F.floor((F.col("_i1") - 1) / CHUNK))))
    at = F.col("_chunk") * CHUNK
    g = samples.select(key, F.floor(F.col("i") / CHUNK).alias("_chunk"), F.struct("i", "v").alias("_s")).groupBy(key, "_chunk").agg(F.array_sort(F.collect_list("_s")).alias("_x"))
    j = a.join(g, [key, "_chunk"])
    cut = F.filter("_x", lambda s: (s["i"] >= F.col("_i0")) & (s["i"] < F.col("_i1")))
    whole = F.when((F.col("_i0") <= at) & (F.col("_i1") >= at + CHUNK), F.col("_x")).otherwise(cut)
    return j.select(key, "annot_id", "_i0", F.explode(whole).alias("s")).select(key, "annot_id", (F.col("s.i") - F.col("_i0")).alias("k"), F.col("s.v").alias("v"))
