"""Operators on one long signal, of several blocks: four columns of lineitem by turns, four samples a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlate, intervals, signals, transforms
from ..operators.ordered import explode_signal, number_rows, parts_of_rows
from .reference_queries import KEY, TEMPLATE, r6, s6, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
RATE = 1000.0


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def long_signal(spark: SparkSession, d: str) -> DataFrame:
    """rid 0, i, v: quantity, discount, tax and price (scaled) of each line item, in order."""
    rows = table(spark, d, "lineitem").selectExpr("0L rid", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice p", "array(l_quantity, 100 * l_discount, -100 * l_tax, l_extendedprice / 1000) x")
    at = number_rows(rows, KEY, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p"], "n", F.floor(F.col("l_orderkey") / 4096), scan=True)
    return at.select("rid", "n", F.posexplode("x").alias("j", "v")).select("rid", (F.col("n") * 4 + F.col("j")).alias("i"), "v")


def long_parts(spark: SparkSession, d: str) -> DataFrame:
    """long_signal as array parts: rid, first, samples, n."""
    rows = table(spark, d, "lineitem").selectExpr("0L rid", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice p", "l_quantity q", "l_discount d", "l_tax t")
    return parts_of_rows(rows, KEY, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p"], ["q", "d", "t", "p"], lambda q, d, t, p: (q, 100 * d, -100 * t, p / 1000), 4, F.floor(F.col("l_orderkey") / 4096))


_LONG = """num as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 n from lineitem),
sig as (select 0::bigint rid, n * 4 i, l_quantity v from num union all select 0, n * 4 + 1, 100 * l_discount from num union all select 0, n * 4 + 2, -100 * l_tax from num union all select 0, n * 4 + 3, l_extendedprice / 1000 from num),
tot as (select count(*) n from sig)"""
_BIN = f"with {_LONG}, q as (select rid, i, v, n // 440 k from sig, tot), p as (select q.*, n // k q, n % k r from q, tot), b as (select rid, v, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end i from p)"


@query("long_bin_max", _BIN + f" select rid, i, {s6('max(v)')} v from b group by rid, i")
def _(spark, d):
    return transforms.envelope(long_signal(spark, d), KEY, RATE, "binmax", bin_size=440).select("rid", "i", r6("v").alias("v"))


@query("long_robust", _BIN + f" select rid, i, {s6('pi() * quantile_cont(abs(v), 0.95)')} v from b group by rid, i")
def _(spark, d):
    return transforms.envelope(long_signal(spark, d), KEY, RATE, "robust").select("rid", "i", r6(F.pi() * F.col("v")).alias("v"))


@query("long_teager", f"with {_LONG}, w as (select *, lag(v) over w p, lead(v) over w q from sig window w as (partition by rid order by i)) select rid, i - 1 i, {s6('v * v - p * q')} v from w where p is not null and q is not null")
def _(spark, d):
    return transforms.envelope(long_signal(spark, d), KEY, RATE, "teager").select("rid", "i", r6("v").alias("v"))


@query("long_islands", f"with {_LONG}, f as (select *, v >= 5 a from sig), g as (select *, sum(case when a then 0 else 1 end) over (partition by rid order by i) g from f), r as (select rid, g, min(i) i0, max(i) i1, max(v) m from g where a group by rid, g having max(v) > 40) select rid, row_number() over (partition by rid order by i0) - 1 annot_id, greatest(i0 - 1, 0)::double \"start\", (i1 + 1)::double \"end\", {s6('m')} max_env from r")
def _(spark, d):
    a = intervals.segment_islands(long_signal(spark, d), 5.0, 40.0)
    return a.select("rid", "annot_id", "start", "end", r6("max_env").alias("max_env"))


@query("long_pearson", f"with {_LONG}, w as (select rid, i, v, lead(v) over g v1, lead(v, 2) over g v2, lead(v, 3) over g v3, lead(v, 4) over g v4 from sig window g as (partition by rid order by i)), s as (select rid, i, 10 * v + 40 * v1 + 90 * v2 + 40 * v3 + 10 * v4 t, v + v1 + v2 + v3 + v4 s1, v * v + v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4 s2 from w where v4 is not null) select rid, i, {s6('case when 5 * s2 - s1 * s1 > 1e-9 then (t - 38 * s1) / sqrt(856.0::double) / sqrt(5 * s2 - s1 * s1) end')} v from s")
def _(spark, d):
    return correlate.sliding(long_signal(spark, d), KEY, TEMPLATE).select("rid", "i", r6("v").alias("v"))


@query("long_resample", f"with {_LONG}, g as (select j i, (j + 0.5) / 0.3 t from tot, lateral (select unnest(range(0, floor(n * 0.3)::bigint)) j) x), h as (select *, least(greatest(floor(t - 0.5), 0), n - 1)::bigint lo from g, tot) select a.rid, h.i, {s6('a.v + (b.v - a.v) * least(greatest(t - 0.5 - lo, 0), 1)')} v from h join sig a on a.i = h.lo join sig b on b.i = least(h.lo + 1, n - 1)")
def _(spark, d):
    return signals.resample(long_signal(spark, d), KEY, 1.0, 0.3).select("rid", "i", r6("v").alias("v"))


@query("long_lfilter", f"with {_LONG} select rid, i, {s6('sum(v) over (partition by rid order by i rows between 98 preceding and current row) / 99')} v from sig")
def _(spark, d):
    return transforms.lfilter(long_signal(spark, d), KEY, [1 / 99] * 99).select("rid", "i", r6("v").alias("v"))


@query("long_annotation_samples", f"with {_LONG}, a as (select 0::bigint rid, x annot_id, x * 5000 + 0.0::double \"start\", x * 5000 + 7000.0::double \"end\" from (select unnest(range(0, 30)) x)) select a.rid, a.annot_id, count(*) n, {s6('sum(v)')} total, {s6('max(v)')} top from a join sig on i >= \"start\" and i < \"end\" group by a.rid, a.annot_id")
def _(spark, d):
    a = spark.range(30).selectExpr("0L rid", "id annot_id", "id * 5000D start", "id * 5000D + 7000 end")
    c = signals.annotation_samples(long_signal(spark, d), a)
    return c.groupBy("rid", "annot_id").agg(F.count("*").alias("n"), r6(F.sum("v")).alias("total"), r6(F.max("v")).alias("top"))


def _rows_only():
    made = {
        "long_butter_5hz": lambda s: transforms.butter(s, KEY, 44_150.0, high=5.0),
        "long_butter_bandpass": lambda s: transforms.butter(s, KEY, RATE, 5.0, 200.0),
        "long_jarne": lambda s: transforms.envelope(s, KEY, 44_150.0, "jarne"),
        "long_absint": lambda s: transforms.envelope(s, KEY, RATE, "absint"),
        "long_log_robust_teager": lambda s: transforms.envelope(s, KEY, RATE, "log_robust_teager"),
        "long_decimate": lambda s: transforms.decimate(s, KEY, 10),
        "long_welch": lambda s: transforms.welch(s, KEY, RATE),
    }
    for name, f in made.items():
        query(name)(lambda spark, d, f=f: f(long_signal(spark, d)))
    query("long_mindlin")(lambda spark, d: explode_signal(transforms.envelope(long_parts(spark, d), KEY, RATE, "mindlin"), [*KEY, "env_rate"]).select(*KEY, "i", "v", "env_rate"))
    for m in ("scipy", "scipy_praat", "mlab", "mlab_praat"):
        query(f"long_spectrogram_{m}")(lambda spark, d, m=m: transforms.spectrogram(long_parts(spark, d), KEY, RATE, m))


_rows_only()
