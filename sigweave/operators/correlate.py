"""Correlations as joins on positions, for envelopes and short templates; raw audio goes through transforms (FFT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import own_rows, with_halo
from .signals import normalize as normalized, pad


def sliding(samples: DataFrame, keys: Sequence[str], template: Sequence[float], method: str = "pearson", similitude: str = "(1-d)/(1+d)", distance: str = "NED", mode: str = "valid") -> DataFrame:
    """Correlation of the windows of a signal with one template: keys, i, v.

    pearson (per window), pearson_global (dot product with the template as it is / m: normalise before if wanted),
    similitude (1/(1+d) or (1-d)/(1+d), d the NED or SNED distance). A window without spread gives NULL, a template without
    spread zeros (pearson). mode valid: i is the window's start; full and same read zeros beyond the signal's ends, and
    position 0 belongs to the window that starts m - 1 (full) or m // 2 (same) samples before it (see mode_delay). Window
    sums come from a chunked frame with halo: nothing is joined and each sample is copied at most twice.
    """
    import statistics

    m = len(template)
    t = [float(x) for x in template]
    if mode != "valid":
        before = {"full": m - 1, "same": m // 2}[mode]
        samples = pad(samples, keys, before, m - 1 if mode == "full" else m - 1 - before)
    mean, std = sum(t) / m, statistics.pstdev(t)
    h, w = with_halo(samples, keys, "i", 0, m - 1)
    at = lambda k: F.lead("v", k).over(w) if k else F.col("v")
    span = w.rowsBetween(0, m - 1)
    h = h.withColumn("_c", F.count("v").over(span)).withColumn("_s1", F.sum("v").over(span)).withColumn("_s2", F.sum(F.col("v") * F.col("v")).over(span))
    weights = [(x - mean) / std if std > 1e-12 else 0.0 for x in t] if method == "pearson" else t
    h = h.withColumn("_dot", sum((F.lit(float(a)) * at(k) for k, a in enumerate(weights)), F.lit(0.0)))
    if method == "pearson":
        var = m * F.col("_s2") - F.col("_s1") * F.col("_s1")
        v = F.when(var > 1e-9, F.col("_dot") / F.sqrt(F.greatest(var, F.lit(1e-300))))
        v = v if std > 1e-12 else F.lit(0.0)
    elif method == "pearson_global":
        v = F.col("_dot") / m
    elif method == "similitude":
        tt = sum(x * x for x in t)
        d = 1 - F.try_divide(2 * F.col("_dot"), F.col("_s2") + tt)
        d = F.sqrt(F.greatest(d, F.lit(0.0))) if distance == "NED" else d
        v = 1 / (1 + d) if similitude == "1/(1+d)" else (1 - d) / (1 + d)
    else:
        raise ValueError(method)
    return own_rows(h.withColumn("_v", v)).where(F.col("_c") == m).select(*keys, "i", F.col("_v").alias("v"))


def mode_delay(mode: str, m: int, rate: float) -> float:
    """Delay of a trace of sliding: full begins a template before the signal, the others are given none."""
    return -m / rate if mode == "full" else 0.0


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson r of two signals over their common samples, missing pairs left out; no spread gives NULL."""
    j = a.select(*keys, "i", F.nanvl("v", F.lit(None).cast("double")).alias("x")).join(b.select(*keys, "i", F.nanvl("v", F.lit(None).cast("double")).alias("y")), [*keys, "i"]).where("x is not null and y is not null")
    n, sx, sy = F.count("*"), F.sum("x"), F.sum("y")
    g = j.groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"))
    p, q = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    r = F.when((p > 1e-9) & (q > 1e-9), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.greatest(p * q, F.lit(1e-300))))
    return g.select(*keys, "n", r.alias("r"))


def spectrogram_match(spec: DataFrame, template: DataFrame, keys: Sequence[str]) -> DataFrame:
    """2-D Pearson of a spectrogram (keys, seg, f, p) with a template (seg, f, q) sliding in time: keys, seg, r.

    The template is parameter-sized and complete (each f in each of its segments); it becomes one constant. A segment's
    cells are put together, multiplied with each of the template's segments there, and the products meet by (keys,
    start): nothing is joined, and what is shuffled is a row for each segment of spectrogram and template.
    """
    import json

    cells = sorted((r.seg, r.f, r.q) for r in template.select("seg", "f", "q").collect())
    if not cells:
        raise ValueError("an empty template")
    freqs, first = sorted({f for _, f, _ in cells}), cells[0][0]
    n, m = len(cells), sum(q for *_, q in cells) / len(cells)
    std = (sum((q - m) ** 2 for *_, q in cells) / n) ** 0.5
    rows: dict[int, list[float]] = {}
    for seg, _, q in cells:
        rows.setdefault(seg - first, []).append((q - m) / std if std > 0 else 0.0)
    if any(len(z) != len(freqs) for z in rows.values()):
        raise ValueError("the template lacks cells")
    known = spec.where(F.col("f").isin(freqs)).groupBy(*keys, "seg").agg(F.array_sort(F.collect_list(F.struct("f", "p"))).alias("_c"), F.sum("p").alias("s1"), F.sum(F.col("p") * F.col("p")).alias("s2"))
    known = known.where(F.size("_c") == len(freqs)).withColumn("_c", F.transform("_c", lambda c: c["p"]))
    tpl = F.from_json(F.lit(json.dumps([{"d": d, "z": z} for d, z in rows.items()])), "array<struct<d bigint, z array<double>>>")
    each = known.select(*keys, "seg", "s1", "s2", "_c", F.explode(tpl).alias("t"))
    dot = F.aggregate(F.zip_with("_c", "t.z", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    g = each.select(*keys, (F.col("seg") - F.col("t.d")).alias("seg"), dot.alias("dot"), "s1", "s2").groupBy(*keys, "seg").agg(F.count("*").alias("n"), F.sum("dot").alias("dot"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
    var = n * F.col("s2") - F.col("s1") * F.col("s1")
    return g.where(F.col("n") == len(rows)).select(*keys, "seg", F.when(var > 1e-12, F.col("dot") / F.sqrt(F.greatest(var, F.lit(1e-300)))).alias("r"))


def _metric(metric: str, similitude: str = "(1-d)/(1+d)", distance: str = "NED"):
    """Value of a window from its sums n, sx, sy, sxy, sxx, syy (y is the part that slides)."""
    n, sx, sy, sxy, sxx, syy = (F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy"))
    if metric == "pearson":
        p, q = n * sxx - sx * sx, n * syy - sy * sy
        return F.when((p > 1e-9) & (q > 1e-9), (n * sxy - sx * sy) / F.sqrt(F.greatest(p * q, F.lit(1e-300))))
    if metric == "pearson_global":
        return sxy / n
    if metric != "similitude":
        raise ValueError(metric)
    d = 1 - F.try_divide(2 * sxy, sxx + syy)
    d = F.sqrt(F.greatest(d, F.lit(0.0))) if distance == "NED" else d
    return 1 / (1 + d) if similitude == "1/(1+d)" else (1 - d) / (1 + d)


def _sums():
    x, y = F.col("x"), F.col("y")
    return [F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy")]


def lagged(a: DataFrame, b: DataFrame, keys: Sequence[str], window: int, step: int, max_lag: int, metric: str = "pearson", normalize: str | None = None, **options) -> DataFrame:
    """Parallel correlation spectrogram: the metric of a's window starting at c with b shifted by lag: keys, c, lag, r.

    metric pearson, pearson_global or similitude (options as in sliding); normalize (see signals.normalize) is done to both
    signals before, with meanstd for pearson_global unless given. a's samples are dealt to the windows they are in
    (window / step each) before the join on b's position, so the work is |centres| * |lags| * window rows, spread by
    (keys, c, lag). Windows are full; lags reaching outside b are left out.
    """
    how = normalize or ("meanstd" if metric == "pearson_global" else None)
    if how:
        a, b = normalized(a, keys, how), normalized(b, keys, how)
    x = a.select(*keys, F.col("i").alias("_i"), F.col("v").alias("x"), F.explode(F.sequence(F.greatest(F.ceil((F.col("i") - window + 1) / step), F.lit(0)), F.floor(F.col("i") / step))).alias("_w"))
    x = x.withColumn("c", F.col("_w") * step).withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("i", F.col("_i") + F.col("lag"))
    j = x.join(b.select(*keys, "i", F.col("v").alias("y")), [*keys, "i"])
    g = j.groupBy(*keys, "c", "lag").agg(*_sums())
    return g.where(F.col("n") == window).select(*keys, "c", F.col("lag").cast("bigint").alias("lag"), _metric(metric, **options).alias("r"))


def orthogonal(a: DataFrame, template: DataFrame, keys: Sequence[str], window: int, step: int, metric: str = "pearson", **options) -> DataFrame:
    """Orthogonal correlation spectrogram: the metric of each of the template's windows (start c, every step) with each
    full window of a (start i): keys, c, i, r.

    The template (keys, i, v: one for each signal, parameter-sized) meets a's samples within a block: its windows are
    arrays, joined by keys, and slide over a's samples by frames with halo, as arrays too.
    """
    m = window
    tpl = template.select(*keys, F.col("i").alias("_i"), F.col("v").alias("_v"), F.explode(F.sequence(F.greatest(F.ceil((F.col("i") - m + 1) / step), F.lit(0)), F.floor(F.col("i") / step))).alias("_w"))
    tpl = tpl.groupBy(*keys, (F.col("_w") * step).alias("c")).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_t")).where(F.size("_t") == m)
    tpl = tpl.select(*keys, "c", F.transform("_t", lambda t: t["_v"]).alias("_t"))
    h, w = with_halo(a.select(*keys, "i", "v"), keys, "i", 0, m - 1)
    wins = own_rows(h.withColumn("_x", F.collect_list("v").over(w.rowsBetween(0, m - 1)))).where(F.size("_x") == m)
    j = wins.join(tpl, list(keys))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)
    dot = lambda p, q: total(F.zip_with(p, q, lambda x, y: x * y))
    s = j.select(*keys, "c", "i", F.lit(m).alias("n"), total(F.col("_t")).alias("sx"), total(F.col("_x")).alias("sy"), dot("_t", "_x").alias("sxy"), dot("_t", "_t").alias("sxx"), dot("_x", "_x").alias("syy"))
    return s.select(*keys, "c", "i", _metric(metric, **options).alias("r"))


def dft_power(frames: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Power of the one-sided DFT of short frames (keys, j, v): keys, f, power. For small sizes; else transforms."""
    import math

    w = -2 * math.pi / size
    each = frames.select(*keys, "j", "v", F.explode(F.sequence(F.lit(0), F.lit(size // 2))).alias("f"))
    g = each.groupBy(*keys, "f").agg(F.sum(F.col("v") * F.cos(F.lit(w) * F.pmod(F.col("j") * F.col("f"), F.lit(size)))).alias("re"), F.sum(F.col("v") * F.sin(F.lit(w) * F.pmod(F.col("j") * F.col("f"), F.lit(size)))).alias("im"))
    return g.select(*keys, F.col("f").cast("bigint").alias("f"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
