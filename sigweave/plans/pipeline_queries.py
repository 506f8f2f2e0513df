"""Queries of the chains and small relations in operators.pipeline."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import intervals, pipeline
from .reference_queries import _A, _CUT, _N, _REC, _SIG, KEY, SQL as SQL_OF, TEMPLATE, ann_a, annots, r6, records, s6, sig, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("extents", f'with {_SIG}, {_N} select rid, n, 0.25 sampling, n / 4.0::double duration, 1.5::double "start", n / 4.0::double + 1.5 "end" from n'.replace("0.25 sampling", "0.25::double sampling"))
def _(spark, d):
    return pipeline.extents(sig(spark, d), KEY, 4.0, 1.5)


@query("shift_end", f"with {_SIG}, {_N} select rid, 100.0 - n::double delay from n")
def _(spark, d):
    e = pipeline.extents(sig(spark, d), KEY, 1.0)
    return e.select("rid", pipeline.shifted_delay(F.lit(0.0), F.col("duration"), end=100.0).alias("delay"))


@query("zeros", "select 7::bigint rid, unnest(range(0, 441)) i, 0.0::double v")
def _(spark, d):
    return pipeline.zeros(spark, {"rid": 7}, rate=44.1, duration=10.0).withColumn("rid", F.col("rid").cast("bigint"))


@query("roll0", f"with {_SIG} select rid, i, coalesce(lag(v, 3) over (partition by rid order by i), 0) v from sig")
def _(spark, d):
    return pipeline.roll0(sig(spark, d), KEY, 3)


@query("roll0_back", f"with {_SIG} select rid, i, coalesce(lead(v, 2) over (partition by rid order by i), 0) v from sig")
def _(spark, d):
    return pipeline.roll0(sig(spark, d), KEY, -2)


@query("clip_normalize", f"with {_SIG} select rid, i, {s6('least(greatest((v - 10) / 60, 0), 1)')} v from sig")
def _(spark, d):
    return sig(spark, d).select("rid", "i", r6(pipeline.clip_normalize(F.col("v"), 10.0, 70.0)).alias("v"))


_SPEC = f"{_SIG}, sp as (select rid, i // 8 seg, i % 8 freq_idx, (i % 8) * 125.0 freq, log10(v) p from sig)"


def spec(spark, d):
    i = F.col("i")
    return sig(spark, d).select("rid", F.floor(i / 8).alias("seg"), (i % 8).alias("freq_idx"), ((i % 8) * 125.0).alias("freq"), F.log10("v").alias("log10_power"))


@query("spectrogram_db", f"with {_SPEC} select rid, seg, freq_idx, {s6('greatest(10 * p, 10 * max(p) over (partition by rid) - 12)')} db from sp")
def _(spark, d):
    return pipeline.decibels(spec(spark, d), KEY, 12.0).select("rid", "seg", "freq_idx", r6("db").alias("db"))


@query("nearest_freq_slice", f"with {_SPEC} select rid, seg, freq_idx, {s6('p')} p from sp where freq_idx >= 2 and freq_idx < 6")
def _(spark, d):
    return pipeline.frequency_slice(spec(spark, d), 270.0, 760.0).select("rid", "seg", "freq_idx", r6("log10_power").alias("p"))


@query("transform_by", "select event_id, user_id, count(*) over (partition by user_id) n, max(value) over (partition by user_id) top from events")
def _(spark, d):
    return pipeline.transform_by(table(spark, d, "events").select("event_id", "user_id", "value"), ["user_id"], n="count(*)", top="max(value)").select("event_id", "user_id", "n", "top")


@query("record_at", f"with {_REC} select record_id, rig from rec qualify row_number() over (order by record_id desc) = 3")
def _(spark, d):
    return pipeline.record_at(records(spark, d).select("record_id", "rig"), -3)


@query("rename_channels", f"with {_REC} select record_id, 'sound' channel, ch_s_file file, 0.0::double delay from rec where ch_s_file is not null and ch_vs_file is not null union all select record_id, 'pressure', ch_vs_file, 0.0 from rec where ch_s_file is not null and ch_vs_file is not null")
def _(spark, d):
    from ..operators import catalogue

    return pipeline.rename_channels(catalogue.record_channels(records(spark, d)), {"s": "sound", "vs": "pressure"})


@query("annot_load_by_slot", 'with cur as (select record_id, annot_id, "start", "end" from annot_db where record_id is not null and annot_id is not null qualify row_number() over (partition by record_id, annot_id order by updated_at desc nulls last, loaded_at desc nulls last, "start" desc nulls last, "end" desc nulls last, comment desc nulls last) = 1) select record_id, floor("start" / 64)::bigint slot, count(*) n, ' + s6('max("end" - "start")') + " longest from cur group by all")
def _(spark, d):
    c = pipeline.count_by_slot(annots(spark, d), "record_id", 64.0)
    return c.select("record_id", "slot", "n", r6("longest").alias("longest"))


@query("calculate_udf", f"with {_SIG}, {_A} select a.rid, a.annot_id, {s6('sum(v)')} total, {s6('max(v) - min(v)')} spread, null::varchar error from a join sig on sig.rid = a.rid and sig.i >= a.\"start\" and sig.i < a.\"end\" group by a.rid, a.annot_id")
def _(spark, d):
    c = pipeline.calculate(sig(spark, d), ann_a(spark, d), "rid", 1.0, {"total": lambda x: x.sum(), "spread": lambda x: x.max() - x.min()})
    return c.select("rid", "annot_id", r6("total").alias("total"), r6("spread").alias("spread"), "error")


@query("last_before", "select a.event_id, (select max_by(b.value, b.ts) from events b where b.user_id = a.user_id and b.event_type = 'view' and b.ts <= a.ts) last_view from events a where event_type = 'click'")
def _(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return pipeline.last_before(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "last_view").select("event_id", "last_view")


@query("preprocess_channels")
def _(spark, d):
    s = sig(spark, d).withColumn("channel", F.when(F.col("rid") % 2 == 0, "s").otherwise("vs"))
    return pipeline.preprocess(s, KEY, {"s": lambda x: x - np.mean(x)})


@query("preprocess_detrend", f"with {_SIG} select rid, i, {s6('pi() * case when rid % 2 = 0 then v - avg(v) over (partition by rid) else v end')} v from sig")
def _(spark, d):
    s = sig(spark, d).withColumn("channel", F.when(F.col("rid") % 2 == 0, "s").otherwise("vs"))
    return pipeline.preprocess(s, KEY, {"s": lambda x: x - np.mean(x)}).select("rid", "i", r6(F.pi() * F.col("v")).alias("v"))


@query("detect_envelope")
def _(spark, d):
    return pipeline.detect(sig(spark, d), "rid", 100.0, 3, 5.0, (60.0, 20.0))


_OWN = f"""with {_SIG}, f as (select *, v >= 20 and i > 0 a from sig), g as (select *, sum(case when a then 0 else 1 end) over (partition by rid order by i) g from f),
r as (select rid, g, min(i) i0, max(i) i1, max(v) m from g where a group by rid, g having max(v) > 60)
select rid, row_number() over (partition by rid order by i0) - 1 annot_id, greatest(i0 - 1, 0)::double "start", i1 + 1.0::double "end", m max_env from r"""


@query("detect_function", _OWN)
def _(spark, d):
    def silent_start(x):
        return np.where(np.arange(len(x)) > 0, x, 0.0)

    return pipeline.detect(sig(spark, d), "rid", 1.0, threshold=(60.0, 20.0), envelope=silent_start)


@query("match_template")
def _(spark, d):
    return pipeline.match(sig(spark, d), "rid", TEMPLATE, 1.0, 0.6)


@query("match_robust")
def _(spark, d):
    return pipeline.match(sig(spark, d), "rid", TEMPLATE, 1.0, robust=0.5)


@query("match_preprocessed")
def _(spark, d):
    return pipeline.match(sig(spark, d), "rid", TEMPLATE, 1.0, 0.6, preprocess=lambda x: np.log1p(np.abs(x)))


@query("match_envelope")
def _(spark, d):
    t = pipeline.Template([20.0, 80.0, 80.0, 20.0], 50.0, "env", "binmax", {"bin_size": 2})
    return pipeline.match(sig(spark, d), "rid", t, 100.0, 0.5)


@query("match_spectrogram")
def _(spark, d):
    cells = [(seg, f, float(-f * (1 + seg))) for seg in range(2) for f in range(5)]
    t = pipeline.Template(cells, 25.0, "spe", "scipy", {"nperseg": 8, "noverlap": 4})
    return pipeline.match(sig(spark, d), "rid", t, 100.0, 0.3)


@query("match_own_template")
def _(spark, d):
    return pipeline.match(sig(spark, d), "rid", lambda x: x[3:9], 1.0, 0.7)


@query("ensemble_resampled")
def _(spark, d):
    s = sig(spark, d)
    return pipeline.ensemble_of(s, intervals.segment_islands(s, 20, 60), "rid", 1.0, 2.0)


@query("ensemble_get", f"with {_SIG}, {_A}, {_CUT}, dd as (select rid, annot_id, k, v - lag(v) over (partition by rid, annot_id order by k) v from cut), c as (select rid, annot_id, k - 1 k, v from dd where v is not null), top as (select max(k) t from c), g as (select rid, annot_id, unnest(range(0, t + 1)) k from (select distinct rid, annot_id from c), top) select g.rid, g.annot_id, g.k, {s6('coalesce(c.v, 0)')} v from g left join c on g.rid = c.rid and g.annot_id = c.annot_id and g.k = c.k")
def _(spark, d):
    s = sig(spark, d)
    e = pipeline.ensemble_of(s, intervals.segment_islands(s, 20, 60), "rid", 1.0, get=np.diff)
    return e.select("rid", "annot_id", "k", r6("v").alias("v"))


@query("transform_function", "select event_id, event_type || ':' || round(value)::bigint label, 2 * value double_value from events")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    e = pipeline.transform_rows(e, "label", lambda r: f"{r['event_type']}:{int(r['value'] + 0.5)}", "string")
    return pipeline.transform_rows(e, "double_value", lambda r: 2 * r["value"], "double").select("event_id", "label", "double_value")


@query("consolidate_function", SQL_OF["consolidate"])
def _(spark, d):
    m = intervals.consolidate(ann_a(spark, d), lambda r: r["consolidated_duration"] / r["duration"] > 0.9 and r["duration"] < 40, ["max_env"])
    return m.select("rid", "annot_id", "start", "end", r6("duration").alias("duration"), r6("consolidated_duration").alias("consolidated_duration"), "n", r6("max_env").alias("max_env"))


@query("consolidate_parts", SQL_OF["consolidate"])
def _(spark, d):
    # runs shorter than 40 of which nine tenths are covered cannot hold a gap of 4
    m = intervals.consolidate(ann_a(spark, d), "consolidated_duration / duration > 0.9 and duration < 40", ["max_env"], max_gap=4.0)
    return m.select("rid", "annot_id", "start", "end", r6("duration").alias("duration"), r6("consolidated_duration").alias("consolidated_duration"), "n", r6("max_env").alias("max_env"))
