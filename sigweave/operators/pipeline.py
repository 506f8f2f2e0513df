"""Chains a user calls as one step: detection, template matching, per-interval features, per-channel preprocessing; and
the small relations of signals, axes and records they need."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from . import intervals, signals, transforms
from .common import attach_by_key, carry_forward, shipped
from .ordered import CHUNK, number_rows, own_rows, with_halo


# ---- axes and extents ---------------------------------------------------------------------------------------------


def extents(samples: DataFrame, keys: Sequence[str], rate: float, delay: float = 0.0) -> DataFrame:
    """n, sampling interval, duration, start (left edge) and end (right edge) of each signal."""
    n = signals.lengths(samples, keys)
    return n.select(*keys, "n", F.lit(1.0 / rate).alias("sampling"), (F.col("n") / rate).alias("duration"), F.lit(float(delay)).alias("start"), (F.col("n") / rate + delay).alias("end"))


def shifted_delay(delay: Column, duration: Column, *, by: float | None = None, start: float | None = None, end: float | None = None, to: float | None = None) -> Column:
    """New delay of a signal moved by an amount, or so that its start, its end or its delay has a value: exactly one."""
    given = [x is not None for x in (by, start, end, to)]
    if sum(given) != 1:
        raise ValueError("exactly one of by, start, end and to")
    if by is not None:
        return delay + F.lit(by)
    if end is not None:
        return F.lit(end) - duration
    return F.lit(start if start is not None else to).cast("double")


def zeros(spark, keys: dict[str, object], rate: float | None = None, duration: float | None = None, samples: int | None = None) -> DataFrame:
    """A signal of zeros (keys, i, v) from exactly two of rate, duration and samples."""
    if sum(x is not None for x in (rate, duration, samples)) != 2:
        raise ValueError("exactly two of rate, duration and samples")
    n = samples if samples is not None else int(rate * duration)
    return spark.range(n).select(*[F.lit(v).alias(k) for k, v in keys.items()], F.col("id").alias("i"), F.lit(0.0).alias("v"))


def roll0(samples: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Values moved by shift positions, zeros coming in (nothing comes round)."""
    h, w = with_halo(samples, keys, "i", max(shift, 0), max(-shift, 0))
    moved = F.lag("v", shift, 0.0).over(w) if shift >= 0 else F.lead("v", -shift, 0.0).over(w)
    return own_rows(h.withColumn("_m", moved)).withColumn("v", F.col("_m")).drop("_m")


def clip_normalize(v: Column, low: float, high: float) -> Column:
    """[low, high] to [0, 1], clamped; NaN stays."""
    return signals.clip((v - low) / (high - low), 0.0, 1.0)


def decibels(spec: DataFrame, keys: Sequence[str], dynamic_range: float = 70.0) -> DataFrame:
    """10 * log10 power, not lower than dynamic_range below the signal's greatest value: adds db."""
    top = spec.groupBy(*keys).agg(F.max("log10_power").alias("_top"), F.count("*").alias("_w"))
    j = attach_by_key(spec, top, keys, "_w", signals.all_of(top, "_w"), F.xxhash64(*spec.columns)).drop("_w")
    return j.withColumn("db", F.greatest(10 * F.col("log10_power"), 10 * F.col("_top") - dynamic_range)).drop("_top")


def frequency_slice(spec: DataFrame, low: float, high: float) -> DataFrame:
    """Rows from the frequency nearest to low up to, without, the one nearest to high. The axis is a small relation."""
    axis = spec.groupBy("freq_idx").agg(F.min("freq").alias("freq"))
    nearest = lambda f: axis.select(F.min_by("freq_idx", F.struct(F.abs(F.col("freq") - f), F.col("freq_idx")))).scalar()
    return spec.where((F.col("freq_idx") >= nearest(low)) & (F.col("freq_idx") < nearest(high)))


def nearest_offset(start: Column, other: Column, rate: float) -> Column:
    """Position of the first of two signals' samples of one rate that is nearest to where the other begins."""
    return F.bround((other - start) * rate, 0).cast("bigint")


# ---- records ------------------------------------------------------------------------------------------------------


def transform_by(df: DataFrame, by: Sequence[str], **columns: str) -> DataFrame:
    """Columns computed from group aggregates: each value is a Spark SQL aggregate, joined back to its group's rows."""
    g = df.groupBy(*by).agg(*[F.expr(e).alias(n) for n, e in columns.items()], F.count("*").alias("_w"))
    rest = df.drop(*columns)
    return attach_by_key(rest, g, by, "_w", signals.all_of(g, "_w"), F.xxhash64(*rest.columns), "left").drop("_w")


def record_at(records: DataFrame, position: int, key: str = "record_id") -> DataFrame:
    """The record at a position of the order by key; negative positions count from the end. No row if outside."""
    order = F.col(key).asc() if position >= 0 else F.col(key).desc()
    return records.orderBy(order).offset(position if position >= 0 else -position - 1).limit(1)


def transform_rows(df: DataFrame, name: str, f: Callable[[dict], object], kind: str) -> DataFrame:
    """Adds name of SQL type kind: a user function of each row as a dict. One that raises gives NULL."""
    ddl = ", ".join(f"`{c}` {t}" for c, t in df.drop(name).dtypes) + f", `{name}` {kind}"

    def value(row):
        try:
            return f(row)
        except Exception:
            return None

    def run(batches):
        for pdf in batches:
            rows = pdf.to_dict("records")
            out = pdf.copy()
            out[name] = pd.Series([value(r) for r in rows], index=pdf.index, dtype=object)
            yield out

    return shipped(df.drop(name)).mapInPandas(run, ddl)


def rename_channels(channels: DataFrame, names: dict[str, str], keep_delay: bool = False) -> DataFrame:
    """Only the named channels of records that have them all, under new names; delays become 0 unless kept."""
    mapping = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    c = channels.where(F.col("channel").isin(list(names)))
    full = c.groupBy("record_id").agg(F.countDistinct("channel").alias("_k")).where(F.col("_k") == len(names)).drop("_k")
    c = c.join(full, "record_id", "left_semi").withColumn("channel", F.try_element_at(mapping, F.col("channel")))
    return c if keep_delay else c.withColumn("delay", F.lit(0.0))


# ---- chains -------------------------------------------------------------------------------------------------------


def preprocess(samples: DataFrame, keys: Sequence[str], by_channel: dict[str, Callable[[np.ndarray], np.ndarray]], channel: str = "channel", halo: int | None = None) -> DataFrame:
    """Each channel's signals through its function: keys, i, v; channels without one stay. Channels are pruned before Python.

    A function gets a whole signal, or with halo blocks of it (see transforms.apply). A signal whose function raises
    comes out as one row with i and v NULL.
    """
    cols = [*keys, "i", "v"]
    out = samples.where(~F.col(channel).isin(list(by_channel)) | F.col(channel).isNull()).select(*cols)
    for name, f in by_channel.items():
        out = out.unionByName(transforms.apply(samples.where(F.col(channel) == name), keys, f, halo).select(*cols))
    return out


def detect(
    samples: DataFrame, key: str, rate: float, bin_size: int = 4415, cut_freq: float | None = 5.0, threshold: tuple[float, float] = (0.04, 0.01), delay: float = 0.0,
    envelope: str | Callable[[np.ndarray], np.ndarray] = "jarne", env_rate: float | None = None, **args,
) -> DataFrame:
    """Intervals of a raw signal: an envelope, then hysteresis (upper, lower).

    envelope is one of transforms.envelope (args are its own) or a function of whole signals, whose result has env_rate.
    The envelope is a signal of its own, filtered in blocks with halo and cut into runs. Signals shorter than a bin give
    nothing.
    """
    if callable(envelope):
        env, r = transforms.envelope(samples, [key], rate, envelope, env_rate=env_rate or rate), env_rate or rate
    else:
        if envelope in K.BIN_SIZE:
            args = {"bin_size": bin_size} | args
        if envelope in ("jarne", "robust", "robust_teager", "log_robust_teager"):
            args = {"cut_freq": cut_freq} | args
        env = transforms.envelope(samples, [key], rate, envelope, **args)
        r = rate * args.get("repeat", 1) / args["bin_size"] if envelope in K.BIN_SIZE else rate
    return intervals.segment_islands(env, threshold[1], threshold[0], r, delay, key)


@dataclass(frozen=True)
class Template:
    """A pattern to look for, and how a raw signal becomes of its kind.

    kind wav: values as they are; env: an envelope by method and args at rate; spe: cells (seg, f, q) of a spectrogram by
    method and args, rate being that of its segments.
    """

    values: Sequence
    rate: float
    kind: str = "wav"
    method: str = ""
    args: dict = field(default_factory=dict)

    @property
    def length(self) -> int:
        return len({c[0] for c in self.values}) if self.kind == "spe" else len(self.values)


def conform(samples: DataFrame, keys: Sequence[str], rate: float, to: Template) -> DataFrame:
    """Raw signals made of the template's kind: (keys, i, v), or (keys, seg, f, p) of a spectrogram."""
    if to.kind == "wav":
        if abs(rate - to.rate) > rate / 1000:
            raise ValueError(f"signals of {rate} Hz and a template of {to.rate} Hz")
        return samples.select(*keys, "i", "v")
    if to.kind == "env":
        return transforms.envelope(samples, keys, rate, to.method, **to.args).select(*keys, "i", "v")
    if to.kind == "spe":
        return transforms.spectrogram(samples, keys, rate, to.method, **to.args).select(*keys, "seg", F.col("freq_idx").alias("f"), F.col("log10_power").alias("p"))
    raise ValueError(f"no kind of template {to.kind}")


def match(
    samples: DataFrame, key: str, template: Sequence[float] | Template | Callable[[np.ndarray], np.ndarray], rate: float, threshold: float = 0.7, allow_overlap: float = 0.0, method: str = "pearson",
    scan: tuple[float, float] | None = None, robust: float | None = None, preprocess: Callable[[np.ndarray], np.ndarray] | None = None, max_roi: int | None = 100,
) -> DataFrame:
    """Intervals where a signal resembles a template: correlation trace, then non-maximum suppression (see transforms.match).

    template: values of the signals' rate; a Template, to whose kind the signals are conformed; or a function that gives
    each signal its own. preprocess is done to whole signals first. scan limits the starts to a time range. robust
    replaces the threshold by each record's own: median + robust * 4 * median deviation / 0.6745 of its trace (the trace
    is then shifted so that one threshold serves).
    """
    from . import correlate

    if preprocess:
        samples = transforms.apply(samples, [key], preprocess).where("error is null").select(key, "i", "v")
    if callable(template):
        return _match_own(samples, key, template, rate, threshold, allow_overlap, scan, robust, max_roi)
    if isinstance(template, Template):
        like, samples = template, conform(samples, [key], rate, template)
        rate = like.rate
    else:
        like = Template(template, rate)
    if like.kind == "spe":
        cells = samples.sparkSession.createDataFrame([(int(a), int(b), float(q)) for a, b, q in like.values], "seg bigint, f bigint, q double")
        trace = correlate.spectrogram_match(samples, cells, [key]).select(key, F.col("seg").alias("i"), F.col("r").alias("v"))
    else:
        trace = correlate.sliding(samples, [key], like.values, method)
    if scan:
        trace = trace.where((F.col("i") / rate >= scan[0]) & (F.col("i") / rate < scan[1]))
    if robust is not None:
        own = signals.robust_threshold(trace, [key], robust).select(key, F.col("threshold").alias("_t"), F.col("n").alias("_w"))
        trace = attach_by_key(trace, own, [key], "_w", signals.all_of(own, "_w"), F.col("i")).where(F.col("v") > F.col("_t")).drop("_t", "_w")
        threshold = -np.inf
    return transforms.match(trace, [key], like.length, rate, threshold, allow_overlap, max_roi)


def _match_own(samples, key, template_of, rate, threshold, allow_overlap, scan, robust, max_roi) -> DataFrame:
    """match with a template of each signal's own, from the whole signal: a signal must fit a task."""
    kind = dict(samples.dtypes)[key]

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")["v"].to_numpy(float)
        rows, error = [], None
        try:
            t = np.asarray(template_of(x), float)
            r = K.sliding_pearson(x, t)
            at = np.arange(len(r)) / rate
            if scan:
                r = np.where((at >= scan[0]) & (at < scan[1]), r, np.nan)
            least = threshold
            if robust is not None and np.isfinite(r).any():
                m = np.nanmedian(r)
                least = m + robust * 4 * np.nanmedian(np.abs(r - m)) / 0.6745
            rows = K.suppress(at, r, len(t) / rate, least, allow_overlap)
            if max_roi is not None and len(rows) >= max_roi:
                rows, error = [], "max_roi"
        except Exception as e:
            error = type(e).__name__
        out = [(*k, s, e, c, n, None) for n, (s, e, c) in enumerate(rows)] or ([(*k, None, None, None, None, error)] if error else [])
        return pd.DataFrame(out, columns=[key, "start", "end", "max_cor", "annot_id", "error"]).astype({"start": float, "end": float, "max_cor": float, "annot_id": "Int64"})

    return shipped(samples.select(key, "i", "v")).groupBy(key).applyInPandas(run, f"`{key}` {kind}, start double, end double, max_cor double, annot_id bigint, error string")


def calculate(samples: DataFrame, annots: DataFrame, key: str, rate: float, functions: dict[str, Callable[[np.ndarray], float]], flank: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """User functions of each annotation's samples in one pass: key, annot_id and a column each; error names what failed.

    A function that raises gives NULL for its column, the others still count. An annotation's samples are one group: they
    are bounded by its length, not by its record's.
    """
    cells = signals.annotation_samples(samples, intervals.flanking(annots, *flank), key, rate)
    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    names = list(functions)

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("k")["v"].to_numpy(float)
        row, failed = [], []
        for n in names:
            try:
                row.append(float(functions[n](x)))
            except Exception as e:
                row.append(None)
                failed.append(f"{n}: {type(e).__name__}")
        return pd.DataFrame([(*k, *row, "; ".join(failed) or None)], columns=[key, "annot_id", *names, "error"])

    ddl = f"`{key}` {types[key]}, annot_id bigint, " + ", ".join(f"`{n}` double" for n in names) + ", error string"
    return shipped(cells).groupBy(key, "annot_id").applyInPandas(run, ddl)


def ensemble_of(samples: DataFrame, annots: DataFrame, key: str, rate: float, new_rate: float | None = None, get: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Aligned crops of annotations on the longest one's grid (key, annot_id, k, v), resampled first if new_rate is given.

    get is done to each annotation's samples; what it gives is aligned. One that raises leaves its annotation out.
    """
    from . import ensemble

    s = signals.resample(samples, [key], rate, new_rate) if new_rate else samples
    keys = [key, "annot_id"]
    cells = signals.annotation_samples(s, annots, key, new_rate or rate)
    if get:
        cells = transforms.apply(cells.withColumnRenamed("k", "i"), keys, get).where("error is null").select(*keys, F.col("i").alias("k"), "v")
    return ensemble.build(cells, keys)


def count_by_slot(annots: DataFrame, key: str, slot: float) -> DataFrame:
    """Annotations per record and time slot: the load the interval joins are dealt by."""
    return annots.groupBy(key, F.floor(F.col("start") / slot).alias("slot")).agg(F.count("*").alias("n"), F.max(F.col("end") - F.col("start")).alias("longest"))


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, chunk: Column | None = None) -> DataFrame:
    """As-of join: each left row with the last value of right at or before its time (NULL if none; of equal times any).

    One union, numbered by (keys, time) over chunks of time, and values carried forward along it: no pairs, and no task
    that holds a hot key. chunk must be monotone in time; default: its day, or its thousands if it is a number.
    """
    if chunk is None:
        chunk = F.unix_date(F.to_date(time)) if dict(left.dtypes)[time].startswith(("timestamp", "date")) else F.floor(F.col(time) / 1000)
    kind = dict(right.dtypes)[value]
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_v"), F.xxhash64(*left.columns).alias("_h"))
    b = right.select(*keys, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0)).withColumn("_h", F.xxhash64("_v"))
    u = number_rows(a.unionByName(b, allowMissingColumns=True), keys, [time, "_side", "_h"], "_at", chunk)
    got = carry_forward(u, keys, "_at", "_v", "_before", CHUNK).where("_side = 1")
    return got.select(*[c for c in left.columns if c != value], F.col("_before").alias(value))
