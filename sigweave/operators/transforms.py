"""Array transforms on signals in blocks, through Arrow: filters, envelopes, spectrograms, matching, models.

Samples are gathered into blocks of bounded length with a halo (see ordered.blocks), so no task holds a long signal, and
each result is that of the whole signal: halos are as long as the filter remembers, to 1e-18 of what it held; bins and
segments belong to the signal, not to the block; what hangs on the whole signal (its length, its greatest power) comes
from an aggregate, and analytic signals from near and far samples apart (see longfft).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import longfft, signals
from .common import attach_by_key, shipped
from .ordered import blocks, explode_signal

BLOCK = 1 << 16
#: Numbers that a task gathers before it hands them on.
FLUSH = 1 << 18
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


def _map_blocks(b: DataFrame, keys: Sequence[str], fn: Callable, out: str) -> DataFrame:
    """fn(key values, i0, own0, own_n, x) -> arrays of equal length, one for each column of out after the keys; or None."""
    types = dict(b.dtypes)
    fields = [p.strip().rsplit(" ", 1) for p in out.split(",")]
    listed = pa.list_(pa.float64())
    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{n.strip('`')}` {t}" for n, t in fields)])
    n_keys = len(keys)

    def joined(rb, take, parts):
        index = pa.array(np.concatenate(take))
        cols = [rb.column(k).take(index) for k in range(n_keys)]
        for p, (_, t) in zip(parts, fields, strict=True):
            flat = t != "string" and not t.startswith("array")
            cols.append(pa.array(np.concatenate(p) if flat else [x for q in p for x in q], _ARROW.get(t, listed)))
        return pa.RecordBatch.from_arrays(cols, names=[*keys, *(n.strip("`") for n, _ in fields)])

    def run(batches):
        for rb in batches:
            lists = rb.column(n_keys + 3)
            values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            small = [rb.column(k).to_pylist() for k in range(n_keys + 3)]
            take, parts, held = [], [[] for _ in fields], 0
            for r in range(rb.num_rows):
                row = [c[r] for c in small]
                got = fn(tuple(row[:n_keys]), *row[n_keys:], np.array(values[at[r] : at[r + 1]], float))
                if got is None or not len(got[0]):
                    continue
                take.append(np.full(len(got[0]), r))
                for p, a in zip(parts, got, strict=True):
                    p.append(a)
                held += sum(np.size(x) for x in got[-1]) if fields[-1][1].startswith("array") else len(got[0])
                if held >= FLUSH:  # a batch may hold many blocks, and a block may give many times its own length
                    yield joined(rb, take, parts)
                    take, parts, held = [], [[] for _ in fields], 0
            if take:
                yield joined(rb, take, parts)

    return shipped(b.select(*keys, "i0", "own0", "own_n", "x")).mapInArrow(run, ddl)


def pointwise(samples: DataFrame, keys: Sequence[str], f: Callable[[np.ndarray], np.ndarray], halo: int = 0, size: int = BLOCK, after: int | None = None) -> DataFrame:
    """f: array to array of equal length, on blocks with halo: (keys, i, v), or array parts (keys, first, samples) if these
    came in, so that a chain of filters never has a row a sample."""

    def fn(_, i0, own0, own_n, x):
        y = np.asarray(f(x), float)
        return np.arange(i0 + own0, i0 + own0 + own_n), y[own0 : own0 + own_n]

    def part(*block):
        i, y = fn(*block)
        return i[:1], [y]

    parts = "samples" in samples.columns
    b = blocks(samples, keys, size=max(size, halo), halo=halo, after=after)
    return _map_blocks(b, keys, part if parts else fn, "first bigint, samples array<double>" if parts else "i bigint, v double")


def apply(samples: DataFrame, keys: Sequence[str], f: Callable[[np.ndarray], np.ndarray], halo: int | None = None, size: int = BLOCK) -> DataFrame:
    """A user function of arrays: keys, i, v, error.

    It gets each signal as one array and may give one of another length; a signal must then fit a task. A function that
    looks at halo neighbours only, and keeps the length, may say so: it gets blocks. One that raises gives no values but a
    row with i and v NULL and the error's name.
    """

    def fn(_, i0, own0, own_n, x):
        try:
            y = np.asarray(f(x), float)
            if halo is not None:
                y = y[own0 : own0 + own_n]
        except Exception as e:
            return np.ma.masked_all(1, int), np.ma.masked_all(1), [type(e).__name__]
        return np.ma.array(np.arange(len(y)) + (0 if halo is None else i0 + own0)), np.ma.array(y), [None] * len(y)

    def masked(*a):
        i, v, e = fn(*a)
        return np.where(np.ma.getmaskarray(i), -1, np.ma.getdata(i)), np.where(np.ma.getmaskarray(v), 0.0, np.ma.getdata(v)), e

    b = blocks(samples, keys, size=size, halo=halo) if halo is not None else blocks(samples, keys, size=1 << 62)
    out = _map_blocks(b, keys, masked, "i bigint, v double, error string")
    ok = F.col("error").isNull()
    return out.withColumn("i", F.when(ok, F.col("i"))).withColumn("v", F.when(ok, F.col("v")))


def butter(samples: DataFrame, keys: Sequence[str], rate: float, low: float | None = None, high: float | None = None, order: int = 4, causal: bool = False) -> DataFrame:
    """Butterworth filter, zero-phase unless causal. The halo is what the filter's poles remember, so it grows as cuts fall."""
    n = K.butter_memory(rate, low, high, order)
    return pointwise(samples, keys, lambda x: K.butter(x, rate, low, high, order, causal), n, after=0 if causal else n)


def lfilter(samples: DataFrame, keys: Sequence[str], b: Sequence[float], a: Sequence[float] = (1.0,)) -> DataFrame:
    """Direct filter b / a from rest.

    With a halo as long as its poles remember; one that never forgets (a pole on the unit circle or beyond) streams each
    signal's blocks in order through one task, the filter's few numbers being all that it holds.
    """
    b, a = [float(v) for v in b], [float(v) for v in a]
    n = K.memory(np.roots(a)) if len(a) > 1 else 0
    if n is not None:
        return pointwise(samples, keys, lambda x: K.lfilter(b, a, x), n + len(b), after=0)
    types = dict(samples.dtypes)

    def run(batches):
        now, state = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                key = tuple(r[: len(keys)])
                if key != now:
                    now, state = key, [0.0] * (max(len(a), len(b)) - 1)
                y, state = K.lfilter_state(b, a, np.asarray(r[-1], float), state)
                out = pd.DataFrame({"i": np.arange(r[-2], r[-2] + len(y)), "v": y})
                for k, v in zip(reversed(keys), reversed(key), strict=True):
                    out.insert(0, k, v)
                yield out

    ordered = shipped(blocks(samples, keys).select(*keys, "block", "i0", "x")).repartition(*keys).sortWithinPartitions(*keys, "block")
    return ordered.select(*keys, "i0", "x").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", i bigint, v double")


def integrate(samples: DataFrame, keys: Sequence[str], tau: float, of: Callable[[np.ndarray], np.ndarray] = np.abs) -> DataFrame:
    """Leaky integral of of(x), one sample late, from 0."""
    if tau <= 1:
        raise ValueError("tau must exceed one sample")
    return pointwise(samples, keys, lambda x: K.integrator(of(x), tau), K.memory(np.array([1 - 1.0 / tau])), after=0)


def smooth(samples: DataFrame, keys: Sequence[str], window: int = 7, order: int = 3) -> DataFrame:
    """Savitzky-Golay with fitted borders; signals shorter than the window stay as they are."""
    return pointwise(samples, keys, lambda x: K.savgol(x, window, order), window)


def hilbert(samples: DataFrame, keys: Sequence[str], then: Callable[[np.ndarray], np.ndarray] | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """Magnitude of the analytic signal of the whole signal: in one task up to BLOCK samples, else dealt over tasks.

    Samples or array parts, as they came in. then: a filter of the magnitudes that looks at so many before and after.
    """
    s, n, parts = signals.with_totals(samples, keys), F.col("n"), "samples" in samples.columns
    short = pointwise(s.where(n <= BLOCK), keys, lambda x: then(K.hilbert_magnitude(x)) if then else K.hilbert_magnitude(x))
    long = s.where(n > BLOCK)
    if not parts:
        long = blocks(long, [*keys, "n"]).select(*keys, "n", F.col("i0").alias("first"), F.col("x").alias("samples"))
    out = longfft.magnitude(long, keys, then, before, after)
    return short.unionByName(out if parts else explode_signal(out, keys))


def decimate(samples: DataFrame, keys: Sequence[str], q: int = 10, zero_phase: bool = True) -> DataFrame:
    """Anti-aliased and thinned: the sample at position i * q becomes i."""
    z, p, g = K.chebyshev_lowpass(8, 0.05, 0.8 / q)
    s, n = K.sections(z, p, g), K.memory(p)
    size = max(BLOCK, n) // q * q

    def fn(_, i0, own0, own_n, x):
        y = K.filtfilt(s, x) if zero_phase else K.sos_filter(s, x)
        i = np.arange(i0 + own0, i0 + own0 + own_n)
        keep = i % q == 0
        return i[keep] // q, y[own0 : own0 + own_n][keep]

    return _map_blocks(blocks(samples, keys, size=size, halo=n, after=n if zero_phase else 0), keys, fn, "i bigint, v double")


def _bin_function(samples: DataFrame, keys: Sequence[str], size: int, f: Callable[[np.ndarray], float], repeat: int) -> DataFrame:
    """A user function of each bin's samples, in order: a bin is a group of about size samples."""
    b = signals.with_totals(samples, keys).where(F.col("n") >= size).withColumn("_bin", signals.bin_of(F.col("i"), F.col("n"), size).cast("bigint"))
    g = b.groupBy(*keys, "_bin").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))).alias("v")))).alias("_x"))
    g = g.select(*keys, F.col("_bin").alias("i0"), F.lit(0).alias("own0"), F.lit(1).alias("own_n"), F.transform("_x", lambda s: s["v"]).alias("x"))
    return _map_blocks(g, keys, lambda _, i0, own0, own_n, x: (np.arange(i0 * repeat, (i0 + 1) * repeat), np.full(repeat, float(f(x)))), "i bigint, v double")


def envelope(samples: DataFrame, keys: Sequence[str], rate: float, method: str | Callable[[np.ndarray], np.ndarray] = "jarne", **a) -> DataFrame:
    """Any of the envelopes of whole signals: keys, i, v, env_rate.

    binmax, binmin, binabs, binmap (func), robust, teager, robust_teager, log_robust_teager, jarne, mindlin, absint; or a
    function of arrays, whose result has the rate env_rate (default: the signal's). Bins are those of the signal (see
    signals.bin_of), aggregated without Python except binmap's. teager begins a sample later than its signal. A cut_freq
    that does not lie below half the envelope's rate raises. The logarithm is -inf of 0 and NaN below. mindlin and absint take array parts
    (keys, first, samples) as well and give such parts.
    """
    if callable(method):
        out = apply(samples, keys, method).where("error is null").select(*keys, "i", "v")
        return out.withColumn("env_rate", F.lit(float(a.get("env_rate", rate))))
    if method == "teager":
        return signals.teager(samples, keys).select(*keys, "i", "v").withColumn("env_rate", F.lit(float(rate)))
    if method == "absint":
        return integrate(samples, keys, a.get("tau", 44)).withColumn("env_rate", F.lit(float(rate)))
    if method == "mindlin":
        tau, window, order = a.get("tau", 100), a.get("sg_window", 513), a.get("sg_order", 4)
        if tau <= 1:
            raise ValueError("tau must exceed one sample")
        late = K.memory(np.array([1 - 1.0 / tau])) + window
        y = hilbert(samples, keys, lambda x: K.savgol(K.integrator(np.abs(x), tau), window, order), late, window)
        return y.withColumn("env_rate", F.lit(float(rate)))
    if method not in K.BIN_SIZE:
        raise ValueError(f"no envelope {method}")
    size, repeat, share = a.get("bin_size", K.BIN_SIZE[method]), a.get("repeat", 1), a.get("percentile", 95) / 100
    r = rate * repeat / size
    v = F.col("v")
    of_bin = {"binmax": F.max(v), "binmin": F.min(v), "binabs": F.max(F.abs(v)), "jarne": F.max(F.abs(v)), "robust": F.percentile(F.abs(v), F.lit(share))}
    base = signals.teager(samples, keys) if method.endswith("teager") else samples
    if method == "binmap":
        out = _bin_function(base, keys, size, a.get("func", np.mean), repeat)
    else:
        out = signals.bins(base, keys, size, of_bin.get(method, F.percentile(v, F.lit(share))), repeat)
    cut = a.get("cut_freq", 100 if method == "jarne" else None)
    if cut is not None and method not in ("binmax", "binmin", "binabs", "binmap"):
        out = butter(out, keys, r, high=K.checked_cut(cut, r))
    if method == "log_robust_teager":
        out = out.withColumn("v", F.when(v > 0, F.log10(v)).when(v == 0, float("-inf")).when(v.isNotNull(), float("nan")))
    return out.select(*keys, "i", "v").withColumn("env_rate", F.lit(float(r)))


def spectrogram(samples: DataFrame, keys: Sequence[str], rate: float, method: str = "scipy", tlim: tuple[float, float] | None = None, delay: float = 0.0, **args) -> DataFrame:
    """keys, seg, t, freq_idx, freq, log10_power of whole signals: scipy, scipy_praat, mlab or mlab_praat settings.

    Segments start in their block and reach into its halo: each comes once. The overlap of scipy_praat follows from the
    signal's length, the floor of the praat methods from its greatest power. tlim limits the signal to [start, end) first.
    Signals shorter than a segment have none. They may also come as array parts (keys, first, samples).
    """
    if tlim:
        first = max(0, int((tlim[0] - delay) * rate // 1))
        samples = signals.crop(samples if "i" in samples.columns else explode_signal(samples, keys), keys, *tlim, rate, delay).withColumn("i", F.col("i") - first)
        delay = delay + first / rate
    given = K.spectrogram_settings(method, rate, None, **args)
    keep, size = given.pop("keep"), given["nperseg"]
    s, lap, own = samples, F.lit(given.pop("noverlap")), ["first", "samples"] if "samples" in samples.columns else ["i", "v"]
    if method == "scipy_praat":
        most = int(size * (1 - 1 / (8 * np.sqrt(np.pi))))
        s = signals.with_totals(samples, keys)
        lap = F.least(F.greatest((F.lit(size) - F.col("n") / float(args.get("time_steps", 1000))).cast("bigint"), F.lit(0)), F.lit(most))
    s = s.select(*keys, *own, (F.lit(size) - lap).cast("bigint").alias("_hop"))
    span = F.col("_hop") * F.greatest(F.floor(F.lit(BLOCK) / F.col("_hop")), F.lit(1))
    inner = [*keys, "_hop"]

    def fn(key, i0, own0, own_n, x):
        hop, at = int(key[-1]), i0 + own0
        f, t, p = K.spectrogram(x[own0 : own0 + own_n + size], rate, noverlap=size - hop, **given)
        p = p[:, : -(-own_n // hop)]
        n = p.shape[1]
        seg = at // hop + np.repeat(np.arange(n), len(f))
        return seg, delay + at / rate + np.repeat(t[:n], len(f)), np.tile(np.arange(len(f)), n), np.tile(f, n), p.T.ravel()

    out = _map_blocks(blocks(s, inner, size=span, halo=0, after=size), inner, fn, "seg bigint, t double, freq_idx bigint, freq double, power double").drop("_hop")
    power = F.col("power")
    if keep is not None:
        top = out.groupBy(*keys).agg(F.max("power").alias("_top"), F.count("*").alias("_w"))
        total = top.select(F.coalesce(F.sum("_w"), F.lit(0))).scalar()
        out = attach_by_key(out, top, keys, "_w", total, F.col("seg"))
        power = F.greatest(power, F.col("_top") * 10 ** (-keep / 10))
    return out.select(*keys, "seg", "t", "freq_idx", "freq", F.log10(F.greatest(power, F.lit(K.EPS))).alias("log10_power"))


def welch(samples: DataFrame, keys: Sequence[str], rate: float, nperseg: int = 512) -> DataFrame:
    """Power density by frequency: powers of the segments that start in a block, averaged over blocks in Spark.

    A signal shorter than a segment is one by itself.
    """
    hop = nperseg - nperseg // 2
    size = max(BLOCK // hop, 1) * hop

    def fn(_, i0, own0, own_n, x):
        x = x[own0 : own0 + own_n + nperseg]
        m = len(x) if i0 + own0 == 0 and len(x) < nperseg else nperseg
        f, _t, p = K.spectrogram(x, rate, m, m // 2, "hann", "density")
        p = p[:, : -(-own_n // hop)]
        return (np.arange(len(f)), f, p.sum(axis=1), np.full(len(f), p.shape[1])) if p.shape[1] else None

    parts = _map_blocks(blocks(samples, keys, size=size, halo=0, after=nperseg), keys, fn, "freq_idx bigint, freq double, total double, n bigint")
    return parts.groupBy(*keys, "freq_idx", "freq").agg((F.sum("total") / F.sum("n")).alias("power"))


def match(trace: DataFrame, keys: Sequence[str], m: int, rate: float, threshold: float = 0.7, allow_overlap: float = 0.0, max_roi: int | None = 100, gap: int | None = None) -> DataFrame:
    """Non-maximum suppression of a correlation trace (keys, i, v): keys, annot_id, start, end, max_cor, error.

    Only candidates above the threshold go on. They are cut into clusters wherever two neighbours are further apart than
    a template (their intervals cannot meet), and each cluster is settled by itself, so a long record is many small tasks.
    A record with max_roi intervals or more has none but a row with the error (max_roi None: as many as there are).
    """
    from .ordered import CHUNK, carry_forward, number_rows

    d = m / rate
    cand = trace.where(F.col("v") > threshold).withColumn("_at", F.col("i"))
    far = carry_forward(cand, keys, "i", "_at", "_prev", CHUNK)
    heads = far.withColumn("_head", F.when(F.col("_prev").isNull() | (F.col("i") - F.col("_prev") > (gap or 2 * m)), F.col("i")))
    parts = carry_forward(heads, keys, "i", "_head", "_before", CHUNK).withColumn("_cluster", F.coalesce("_head", "_before"))
    types = {f.name: f.dataType.simpleString() for f in trace.schema}
    n = len(keys)

    def settle(key, pdf):
        pdf = pdf.sort_values("i")
        rows = K.suppress(pdf["i"].to_numpy() / rate, pdf["v"].to_numpy(), d, threshold, allow_overlap)
        return pd.DataFrame([(*key[:n], *r) for r in rows], columns=[*keys, "start", "end", "max_cor"])

    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", start double, end double, max_cor double"
    out = shipped(parts).select(*keys, "_cluster", "i", "v").groupBy(*keys, "_cluster").applyInPandas(settle, ddl)
    out = number_rows(out, list(keys), ["start"], "annot_id", F.floor(F.col("start") * rate / CHUNK)).withColumn("error", F.lit(None).cast("string"))
    if max_roi is None:
        return out
    # of a record with too many, the one numbered max_roi - 1 tells; the numbers below it are bounded
    full = out.where(F.col("annot_id") == max_roi - 1).select(*keys)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "double"), ("end", "double"), ("max_cor", "double"), ("annot_id", "bigint"))]
    return out.join(full, list(keys), "left_anti").unionByName(full.select(*keys, *none, F.lit("max_roi").alias("error")))


def per_group(rows: DataFrame, keys: Sequence[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A model per group of parameter-sized inputs (one ensemble, one song): factorisation, warping, synthesis."""
    return shipped(rows).groupBy(*keys).applyInPandas(fn, schema)


def _typed(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys) + ", "


def nmf(cells: DataFrame, keys: Sequence[str], components: int, lags: int | tuple[int, int] = 0, **options) -> DataFrame:
    """Lagged factorisation of each group's matrix (keys, row, t, y): keys, part ('A', 'X', 'L', 'Y'), r, c, value, residual.

    options are those of kernels.nmf_lag. Part 'Y' is the model; residual is half the squared error.
    """

    def fn(key, pdf):
        y = pdf.pivot_table(index="row", columns="t", values="y", aggfunc="max").sort_index().sort_index(axis=1).to_numpy()
        a, x, lag, model, d = K.nmf_lag(y, components, lags=lags, **options)
        rows = [(*key, part, r, c, float(m[r, c]), d) for part, m in (("A", a), ("X", x), ("L", lag), ("Y", model)) for r in range(m.shape[0]) for c in range(m.shape[1])]
        return pd.DataFrame(rows, columns=[*keys, "part", "r", "c", "value", "residual"])

    return per_group(cells, keys, fn, _typed(cells, keys) + "part string, r bigint, c bigint, value double, residual double")


def stw(pairs: DataFrame, keys: Sequence[str], rate: float, interval: float = 0.1, dmax: float = 0.05, dstep: float = 0.01, delays=None) -> DataFrame:
    """Smooth time warp of x to y per group (keys, i, x, y): keys, knot, time, delay, cor, error.

    delays (see kernels.delays_at) are where the search begins. A group that cannot be warped has one row with its error.
    """

    def fn(key, pdf):
        pdf = pdf.sort_values("i")
        try:
            t, d, r = K.smooth_time_warp(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), rate, interval, dmax, dstep, delays)
            rows = [(*key, k, float(t[k]), float(d[k]), r, None) for k in range(len(t))]
        except ValueError as e:
            rows = [(*key, None, None, None, None, str(e))]
        out = pd.DataFrame(rows, columns=[*keys, "knot", "time", "delay", "cor", "error"])
        return out.astype({"knot": "Int64", "time": float, "delay": float, "cor": float})

    return per_group(pairs, keys, fn, _typed(pairs, keys) + "knot bigint, time double, delay double, cor double, error string")


def warped(samples: DataFrame, keys: Sequence[str], rate: float, delays, interval: float = 0.1) -> DataFrame:
    """Signals read at t + delay(t) (keys, i, v), NULL outside; delays as in kernels.delays_at, the same for every group."""

    def fn(key, pdf):
        pdf = pdf.sort_values("i")
        x = pdf["v"].to_numpy(float)
        knots = K.warp_knots(len(x), rate, interval)
        out = pd.DataFrame({"i": pdf["i"].to_numpy(), "v": K.warp(x, rate, knots, K.delays_at(delays, knots))})
        for k, v in zip(reversed(keys), reversed(key), strict=True):
            out.insert(0, k, v)
        return out

    return per_group(samples, keys, fn, _typed(samples, keys) + "i bigint, v double")


def warp_summary(knots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a warp (keys, knot, time, delay, cor) says of itself: keys, times, delays, min_delay, max_delay, cor, text.

    text is '[[times] [delays]]' with four decimals, which warped and stw take again as delays.
    """
    g = knots.where(F.col("knot").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("knot", "time", "delay"))).alias("_k"), F.min("delay").alias("min_delay"), F.max("delay").alias("max_delay"), F.max("cor").alias("cor"))
    times, delays = F.transform("_k", lambda k: k["time"]), F.transform("_k", lambda k: k["delay"])
    text = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.4f", x)), " "), F.lit("]"))
    return g.select(*keys, times.alias("times"), delays.alias("delays"), "min_delay", "max_delay", "cor", F.concat(F.lit("["), text(times), F.lit(" "), text(delays), F.lit("]")).alias("text"))


def finch(drive: DataFrame, keys: Sequence[str], rate: float, lookup: tuple[Sequence[float], Sequence[float]] | None = None, detune: float | None = None, seed: int = 0, together: int = 256, **options) -> DataFrame:
    """Synthesised songs (keys, i, env, fund or beta): keys, i, beta, syn, labium_0 and, with detune, labium_1.

    lookup gives frequencies and their betas; where drive has a column beta it is taken as it is. detune: the second
    source's beta by the first's. Songs are integrated together, up to so many in a batch; each has its own noise, seeded
    by seed and its keys.
    """
    types = dict(drive.dtypes)
    names = ["syn", "labium_0", *(["labium_1"] if detune is not None else [])]
    value = F.col("beta") if "beta" in drive.columns else F.col("fund")
    if "beta" not in drive.columns and lookup is None:
        raise ValueError("fundamental frequencies need a table of betas")
    songs = drive.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", F.col("env").cast("double").alias("e"), value.cast("double").alias("f")))).alias("_s"))
    songs = songs.select(*keys, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)).alias("_seed"), F.transform("_s", lambda s: s["i"]).alias("_i"), F.transform("_s", lambda s: s["e"]).alias("_e"), F.transform("_s", lambda s: s["f"]).alias("_f"))
    is_beta = "beta" in drive.columns

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), together):
                part = pdf.iloc[at : at + together].reset_index(drop=True)
                sizes = [len(x) for x in part["_i"]]
                env, beta = np.zeros((len(part), max(sizes))), np.full((len(part), max(sizes)), K.SILENT_BETA)
                for k, (e, f) in enumerate(zip(part["_e"], part["_f"], strict=True)):
                    env[k, : len(e)] = e
                    beta[k, : len(f)] = f if is_beta else K.beta_of(np.asarray(f, float), lookup)
                got = K.finch(env, beta, rate, None if detune is None else np.full_like(beta, detune), seeds=[int(s) for s in part["_seed"]], **options)
                frames = []
                for k, n in enumerate(sizes):
                    f = pd.DataFrame({"i": np.asarray(part["_i"][k]), "beta": beta[k, :n], **{c: got[c][k, :n] for c in names}})
                    for c in reversed(keys):
                        f.insert(0, c, part[c][k])
                    frames.append(f)
                yield pd.concat(frames)

    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", i bigint, beta double, " + ", ".join(f"{c} double" for c in names)
    return shipped(songs).mapInPandas(run, ddl)
