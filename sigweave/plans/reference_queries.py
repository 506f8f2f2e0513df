"""One query for each relational, interval, signal and ensemble operator, with the SQL that gives the same rows.

The signal of a user is the events in order (rate 1, delay 0, tjust 0.5); intervals are bursts of that signal; ensembles
are the embeddings; records, channels and files come from record_db and file_db.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, common, correlate, ensemble, intervals, pipeline, pitch, signals, transforms
from ..operators.ordered import number_all, number_rows

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"(round(({x})::double, 6) + 0.0)"


KEY = ["rid"]


def sig(spark: SparkSession, d: str, where: str = "true", extra: list[str] | None = None) -> DataFrame:
    """rid, i, v: events of a user in order."""
    e = table(spark, d, "events").where(where).selectExpr("user_id rid", "ts", "event_id", "value v", *(extra or []))
    return number_rows(e, KEY, ["ts", "event_id"], "i", F.unix_date(F.to_date("ts")), scan=True).drop("ts", "event_id")


def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two channels of each user: clicks and purchases are signals of their own length."""
    return sig(spark, d, "event_type = 'click'"), sig(spark, d, "event_type = 'view'")


_SIG = "sig as (select user_id rid, row_number() over (partition by user_id order by ts, event_id) - 1 i, value v from events)"
_TWO = """ca as (select user_id rid, row_number() over (partition by user_id order by ts, event_id) - 1 i, value v from events where event_type = 'click'),
cb as (select user_id rid, row_number() over (partition by user_id order by ts, event_id) - 1 i, value v from events where event_type = 'view')"""
_N = "n as (select rid, count(*) n from sig group by rid)"


def _islands(name: str, lo: float, hi: float, shift: float) -> str:
    return f"""{name}f as (select *, case when v >= {lo} then 1 else 0 end a from sig),
{name}g as (select *, sum(case when a = 0 then 1 else 0 end) over (partition by rid order by i) gid from {name}f),
{name}r as (select rid, gid, min(i) i0, max(i) i1, max(v) mx from {name}g where a = 1 group by rid, gid having max(v) > {hi}),
{name} as (select rid, row_number() over (partition by rid order by i0) - 1 annot_id, greatest(i0 - 1, 0) + {shift}::double "start", i1 + 1 + {shift}::double "end", mx max_env from {name}r)"""


_A, _B = _islands("a", 20, 60, 0.0), _islands("b", 30, 30, 0.5)


def ann_a(spark: SparkSession, d: str) -> DataFrame:
    return intervals.segment_islands(sig(spark, d), 20, 60)


def ann_b(spark: SparkSession, d: str) -> DataFrame:
    b = intervals.segment_islands(sig(spark, d), 30, 30)
    return b.withColumn("start", F.col("start") + 0.5).withColumn("end", F.col("end") + 0.5)


# ---- interval generators and algebra ------------------------------------------------------------------------------


@query("segment_islands", f'with {_SIG}, {_A} select rid, annot_id, "start", "end", max_env from a')
def _(spark, d):
    return ann_a(spark, d)


@query("detect_all", f'with {_SIG}, {_N} select rid, 0::bigint annot_id, 0.0::double "start", n::double "end" from n')
def _(spark, d):
    return intervals.detect_all(signals.lengths(sig(spark, d), KEY))


@query("annot_renumber", f'with {_SIG}, {_A}, {_B}, u as (select rid, "start", "end" from a union all select rid, "start", "end" from b) select rid, row_number() over (partition by rid order by "start", "end") - 1 annot_id, "start", "end" from u')
def _(spark, d):
    return intervals.renumber(ann_a(spark, d).select("rid", "annot_id", "start", "end").unionByName(ann_b(spark, d).select("rid", "annot_id", "start", "end")))


_X = """from a x join b y on x.rid = y.rid and x."start" < y."end" and x."end" > y."start\""""


@query("annot_intersect", f'with {_SIG}, {_A}, {_B} select x.rid, row_number() over (partition by x.rid order by greatest(x."start", y."start"), least(x."end", y."end"), x.annot_id, y.annot_id) - 1 annot_id, greatest(x."start", y."start") "start", least(x."end", y."end") "end", x.annot_id x_annot_id, y.annot_id y_annot_id {_X}')
def _(spark, d):
    return intervals.intersect(ann_a(spark, d), ann_b(spark, d))


@query("annot_intersect_cols", f'with {_SIG}, {_A}, {_B} select x.rid, greatest(x."start", y."start") "start", least(x."end", y."end") "end", x.annot_id x_annot_id, y.annot_id y_annot_id, x.max_env x_max_env, y.max_env y_max_env {_X}')
def _(spark, d):
    return intervals.intersect(ann_a(spark, d), ann_b(spark, d), x_cols=["max_env"], y_cols=["max_env"]).drop("annot_id")


@query("annot_difference", f"""with {_SIG}, {_A}, {_B},
c as (select x.rid, x.annot_id aid, x."start" xs, x."end" xe, y."start" ys, y."end" ye from a x left join b y on x.rid = y.rid and x."start" < y."end" and x."end" > y."start"),
p as (select *, coalesce(max(ye) over (partition by rid, aid order by ys, ye rows between unbounded preceding and 1 preceding), xs) pe from c),
q as (select rid, aid, greatest(xs, pe) s, least(coalesce(ys, xe), xe) e from p union all select rid, aid, max(ye), max(xe) from p where ye is not null group by rid, aid)
select rid, row_number() over (partition by rid order by s, e, aid) - 1 annot_id, s "start", e "end", aid x_annot_id from q where s < e""")
def _(spark, d):
    return intervals.difference(ann_a(spark, d), ann_b(spark, d))


@query("overlap_filter", f'with {_SIG}, {_A}, {_B} select * from a where exists (select 1 from b where b.rid = a.rid and b."start" < a."end" and b."end" > a."start" and b.max_env > 300)')
def _(spark, d):
    return intervals.overlap_filter(ann_a(spark, d), ann_b(spark, d).where("max_env > 300"))


@query("flanking_extend", f'with {_SIG}, {_A} select rid, annot_id, "start" - 0.25 "start", "end" + 0.75 "end", max_env from a')
def _(spark, d):
    return intervals.flanking(ann_a(spark, d), 0.25, 0.75)


@query("consolidate", f"""with recursive {_SIG}, {_A}, m as (select *, max(annot_id) over (partition by rid) top from a),
f as (select rid, annot_id, "start" s, "end" e, "end" - "start" c, 1::bigint n, annot_id first_id, top, max_env from m where annot_id = 0
union all select f.rid, m.annot_id, case when ok then f.s else m."start" end, m."end", case when ok then f.c + m."end" - m."start" else m."end" - m."start" end, case when ok then f.n + 1 else 1 end, case when ok then f.first_id else m.annot_id end, m.top, case when ok then f.max_env + m.max_env else m.max_env end
  from f join m on m.rid = f.rid and m.annot_id = f.annot_id + 1, lateral (select (f.c + m."end" - m."start") / (m."end" - f.s) > 0.9 and m."end" - f.s < 40 ok) t)
select rid, first_id annot_id, s "start", max(e) "end", {s6("max(e - s)")} duration, {s6("max(c)")} consolidated_duration, max(n) n, {s6("max(max_env)")} max_env from f group by rid, first_id, s""")
def _(spark, d):
    m = intervals.consolidate(ann_a(spark, d), "consolidated_duration / duration > 0.9 and duration < 40", ["max_env"])
    return m.select("rid", "annot_id", "start", "end", r6("duration").alias("duration"), r6("consolidated_duration").alias("consolidated_duration"), "n", r6("max_env").alias("max_env"))


# ---- catalogue ----------------------------------------------------------------------------------------------------

_REC = "rec as (select * from record_db where record_id is not null qualify row_number() over (partition by record_id order by updated_at desc nulls last, loaded_at desc nulls last, ch_s_file nulls last, ch_vs_file nulls last) = 1)"
_FIL = "fil as (select file_id, min(file) file, min(folder) folder, min(duration) duration, min(n_bytes) n_bytes from file_db group by file_id)"


def records(spark: SparkSession, d: str) -> DataFrame:
    cols = ["datetime", "rig", "ch_s_file", "ch_vs_file", "ch_s_id", "ch_vs_id", "ch_vs_delay"]
    return common.current_rows(table(spark, d, "record_db"), ["record_id"], {c: F.col(c) for c in cols}).drop("first_loaded")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_db").groupBy("file_id").agg(*[F.min(c).alias(c) for c in ("file", "folder", "duration", "n_bytes")])


def annots(spark: SparkSession, d: str) -> DataFrame:
    return common.current_rows(table(spark, d, "annot_db"), ["record_id", "annot_id"], {c: F.col(c) for c in ("start", "end", "comment")}).drop("first_loaded")


_ANN = 'ann as (select record_id, annot_id, "start", "end", comment from annot_db where record_id is not null and annot_id is not null qualify row_number() over (partition by record_id, annot_id order by updated_at desc nulls last, loaded_at desc nulls last, "start" desc nulls last, "end" desc nulls last, comment desc nulls last) = 1)'


@query("record_id_from_datetime", "select o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S')::bigint record_id from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", catalogue.record_id(F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "HH.mm.ss")).alias("record_id"))


@query("scan_records", "select record_id, oldrid, strftime(datetime, '%Y-%m-%d %H:%M:%S') stamp, rig, folder from record_db")
def _(spark, d):
    return table(spark, d, "record_db").select("record_id", "oldrid", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "rig", "folder")


@query("record_channels_long", f"with {_REC} select record_id, 's' channel, ch_s_file file, null::double delay from rec where ch_s_file is not null union all select record_id, 'vs', ch_vs_file, ch_vs_delay from rec where ch_vs_file is not null")
def _(spark, d):
    return catalogue.record_channels(records(spark, d))


@query("dedupe_keep_first", "select file, folder, file_id from file_db qualify row_number() over (partition by file, folder order by file_id) = 1")
def _(spark, d):
    return catalogue.keep_first(table(spark, d, "file_db").select("file", "folder", "file_id"), ["file", "folder"], ["file_id"])


@query("file_ids", "select folder, file, row_number() over (order by folder, file) - 1 file_id from (select distinct folder, file from file_db)")
def _(spark, d):
    f = table(spark, d, "file_db").select("folder", "file").distinct()
    return catalogue.file_ids(f, ["folder", "file"])


@query("subset_semi_join", "with r as (select user_id from events where value > 400) select event_id, user_id, value from events where user_id in (select user_id from r)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    keys = e.where("value > 400").select("user_id").distinct()
    return catalogue.subset({"k": keys, "e": e}, "k", "true", "user_id")["e"]


@query("subset_by_annot", f"with {_REC}, {_ANN} select record_id, rig from rec where record_id in (select record_id from ann where comment = 'song')")
def _(spark, d):
    return catalogue.subset({"annots": annots(spark, d), "records": records(spark, d).select("record_id", "rig")}, "annots", "comment = 'song'")["records"]


@query("anti_remaining_records", f"with {_REC}, {_ANN} select record_id, rig from rec where record_id not in (select record_id from ann)")
def _(spark, d):
    return intervals.remaining_records(records(spark, d).select("record_id", "rig"), annots(spark, d))


@query("transform_exprs", f'with {_ANN} select record_id, annot_id, {s6(chr(34) + "end" + chr(34) + " - " + chr(34) + "start" + chr(34))} len, {s6("2 * (" + chr(34) + "end" + chr(34) + " - " + chr(34) + "start" + chr(34) + ")")} twice from ann')
def _(spark, d):
    from ..dataset import Dataset

    ds = Dataset(records(spark, d), annotations={"a": annots(spark, d)}).transform("a", len="end - start", twice="2 * len")
    return ds.annotations["a"].select("record_id", "annot_id", r6("len").alias("len"), r6("twice").alias("twice"))


@query("annot_get_first", f'with {_ANN} select record_id, annot_id, {s6(chr(34) + "start" + chr(34) + " - 0.5")} "start", {s6(chr(34) + "end" + chr(34) + " + 1.0")} "end" from ann where comment = \'song\' order by record_id, annot_id limit 1')
def _(spark, d):
    from ..dataset import Dataset

    a = Dataset(records(spark, d), annotations={"a": annots(spark, d).where("comment = 'song'")}).get_annotation("a", flanking=(0.5, 1.0))
    return a.select("record_id", "annot_id", r6("start").alias("start"), r6("end").alias("end"))


@query("add_file_info", f"with {_REC}, {_FIL} select record_id, ch_s_id, fil.duration s_duration, fil.n_bytes s_n_bytes from rec left join fil on rec.ch_s_id = fil.file_id")
def _(spark, d):
    return catalogue.add_file_info(records(spark, d), files(spark, d), "ch_s_id", ["duration", "n_bytes"], "s_").select("record_id", "ch_s_id", "s_duration", "s_n_bytes")


@query("register_channel", f"with {_REC} select record_id, 's' channel, ch_s_file file, null::double delay from rec where ch_s_file is not null union all select record_id, 'vs', ch_vs_file, ch_vs_delay from rec where ch_vs_file is not null union all select record_id, 'pb', 'pb_' || ch_vs_file, ch_vs_delay from rec where ch_vs_file is not null")
def _(spark, d):
    ch = catalogue.record_channels(records(spark, d))
    mapping = ch.where("channel = 'vs'").select(F.col("file").alias("known_file"), F.concat(F.lit("pb_"), "file").alias("new_file")).distinct()
    return catalogue.register_channel(ch, mapping, "vs", "pb")


@query("channel_file_ids", f"with {_REC}, {_FIL}, byname as (select file, min(file_id) file_id from fil group by file) select record_id, channel, file_id from (select record_id, 's' channel, ch_s_file f from rec where ch_s_file is not null union all select record_id, 'vs', ch_vs_file from rec where ch_vs_file is not null) c left join byname on c.f = byname.file")
def _(spark, d):
    return catalogue.channel_file_ids(catalogue.record_channels(records(spark, d)), files(spark, d))


@query("add_files", "with old as (select row_number() over (order by p_name, p_partkey) - 1 file_id, p_brand || '#' || p_partkey file, p_size size from part where p_partkey % 3 > 0), new as (select p_brand || '#' || p_partkey file, p_size + 1 size from part where p_partkey % 2 = 0), t as (select max(file_id) m from old) select file_id, file, size from old where file not in (select file from new) union all select file_id, file, new.size from new join old using (file) union all select m + row_number() over (order by file), file, size from new, t where file not in (select file from old)")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat_ws("#", "p_brand", "p_partkey").alias("file"), "p_size")
    old = number_all(p.where("p_partkey % 3 > 0"), ["p_name", "p_partkey"], "file_id")
    return catalogue.add_files(old.select("file_id", "file", F.col("p_size").alias("size")), p.where("p_partkey % 2 = 0").select("file", (F.col("p_size") + 1).alias("size"))).select("file_id", "file", "size")


@query("annot_register", f"""with {_REC}, {_ANN} select a.record_id, annot_id, {s6('"start"')} "start", {s6('"end"')} "end", {s6('"end" - "start"')} duration, strftime(datetime + to_microseconds((round("start" * 1000000))::bigint), '%Y-%m-%d %H:%M:%S') stamp, coalesce(comment, '') comment from ann a left join rec r on a.record_id = r.record_id""")
def _(spark, d):
    a = intervals.register(annots(spark, d), records(spark, d))
    return a.select("record_id", "annot_id", r6("start").alias("start"), r6("end").alias("end"), r6("duration").alias("duration"), F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "comment")


@query("set_delay_min_channel", f"with {_REC}, c as (select record_id, 's' channel, 0.25::double delay from rec union all select record_id, 'vs', ch_vs_delay from rec where ch_vs_delay is not null) select record_id, channel, {s6('delay - min(delay) over (partition by record_id) + 1.5')} delay from c")
def _(spark, d):
    r = records(spark, d)
    c = r.selectExpr("record_id", "'s' channel", "0.25D delay").unionByName(r.where("ch_vs_delay is not null").selectExpr("record_id", "'vs' channel", "ch_vs_delay delay"))
    return catalogue.set_delay(c, 1.5).select("record_id", "channel", r6("delay").alias("delay"))


@query("factor_codes", "with l as (select event_type, row_number() over (order by event_type) code from (select distinct event_type from events)) select event_id, event_type, code from events left join l using (event_type)")
def _(spark, d):
    return catalogue.factor_codes(table(spark, d, "events").select("event_id", "event_type"), "event_type", "code")


@query("r_frame", "with l as (select event_type, row_number() over (order by event_type)::int event_type_code from (select distinct event_type from events)) select event_id::varchar event_id, user_id::varchar user_id, event_type, value, event_type_code from events left join l using (event_type)")
def _(spark, d):
    return catalogue.r_frame(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), ["event_type"])


@query("augment_highwater", "select o_orderkey, o_totalprice from orders where coalesce(o_orderkey > (select max(o_orderkey) from orders where o_totalprice < 2000), true)")
def _(spark, d):
    o = table(spark, d, "orders")
    return intervals.high_water(o.select("o_orderkey", "o_totalprice"), o.where("o_totalprice < 2000"), "o_orderkey")


# ---- signals ------------------------------------------------------------------------------------------------------


@query("samples_long", f"with {_SIG} select rid, i, v from sig")
def _(spark, d):
    return sig(spark, d)


@query("times", f"with {_SIG} select rid, i, 2.0 + (i + 0.5) / 4.0 t from sig")
def _(spark, d):
    return sig(spark, d).select("rid", "i", signals.times(F.col("i"), 4.0, 2.0).alias("t"))


@query("crop_signal", f"with {_SIG} select rid, i, v from sig where i >= 5 and i < 20")
def _(spark, d):
    return signals.crop(sig(spark, d), KEY, 5.2, 20.7)


@query("crop_record", f"with {_SIG} select rid, i, v from sig where i >= greatest(0, floor((5.2 - (rid % 5) * 0.7) * (1 + rid % 2))) and i < floor((20.7 - (rid % 5) * 0.7) * (1 + rid % 2))")
def _(spark, d):
    return signals.crop(sig(spark, d), KEY, 5.2, 20.7, (1 + F.col("rid") % 2).cast("double"), (F.col("rid") % 5) * 0.7)


@query("crop_none", f"with {_SIG} select rid, i, v from sig where i >= 1000000")
def _(spark, d):
    return signals.crop(sig(spark, d), KEY, 1_000_000.0, 1_000_010.0)


@query("clip", f"with {_SIG} select rid, i, least(greatest(v, 10.0), 50.0) v from sig")
def _(spark, d):
    return sig(spark, d).withColumn("v", signals.clip(F.col("v"), 10.0, 50.0))


@query("reverse", f"with {_SIG}, {_N} select rid, n - 1 - i i, v from sig join n using (rid)")
def _(spark, d):
    return signals.reverse(sig(spark, d), KEY)


@query("shift_by", f"with {_SIG} select rid, i, 1.25 + (i + 0.5) t from sig")
def _(spark, d):
    return sig(spark, d).select("rid", "i", signals.times(F.col("i"), 1.0, 1.25).alias("t"))


@query("zero_pad", f"with {_SIG}, {_N} select rid, i + 3 i, v from sig union all select rid, g, 0.0::double from n, lateral (select unnest(range(0, 3)) g union all select unnest(range(n + 3, n + 5)) g) t")
def _(spark, d):
    return signals.pad(sig(spark, d), KEY, 3, 2)


@query("nan_pad", f"with {_SIG}, {_N} select rid, i + 3 i, v from sig union all select rid, g, null::double from n, lateral (select unnest(range(0, 3)) g union all select unnest(range(n + 3, n + 5)) g) t")
def _(spark, d):
    return signals.pad(sig(spark, d), KEY, 3, 2, None)


_AT = "case when t < 0 or t > n then {fill} else a.v + (b.v - a.v) * least(greatest(k - lo, 0), 1) end"


@query("resample_linear", f"with {_SIG}, {_N}, g as (select rid, n, j i, (j + 0.5) / 2.5 t from n, lateral (select unnest(range(0, floor(n * 2.5)::bigint)) j) t), h as (select *, t - 0.5 k, least(greatest(floor(t - 0.5), 0), n - 1)::bigint lo from g) select h.rid, h.i, {s6(_AT.format(fill='0'))} v from h join sig a on a.rid = h.rid and a.i = h.lo join sig b on b.rid = h.rid and b.i = least(h.lo + 1, n - 1)")
def _(spark, d):
    return signals.resample(sig(spark, d), KEY, 1.0, 2.5).select("rid", "i", r6("v").alias("v"))


@query("rec_to_dataframe", f"with {_TWO}, n as (select rid, count(*) n from cb group by rid), h as (select ca.rid, ca.i, ca.v, ca.i + 0.5 t, n, (ca.i + 0.5) * 0.5 - 0.5 k from ca left join n using (rid)), l as (select *, least(greatest(floor(k), 0), n - 1)::bigint lo from h) select l.rid, l.i, l.v a, {s6('case when n is null or t > n / 0.5 then null else a.v + (b.v - a.v) * least(greatest(k - lo, 0), 1) end')} b from l left join cb a on a.rid = l.rid and a.i = l.lo left join cb b on b.rid = l.rid and b.i = least(l.lo + 1, n - 1)")
def _(spark, d):
    a, b = two(spark, d)
    p = a.select("rid", "i", F.col("v").alias("a"), (F.col("i") + 0.5).alias("t"))
    return signals.at_times(b, p, KEY, rate=0.5, fill=None).select("rid", "i", "a", r6("v").alias("b"))


# b has half the rate and begins 1.2 later: sample i of a lies at b's position k
_ON_A = f"with {_TWO}, n as (select rid, count(*) n from cb group by rid), h as (select ca.rid, ca.i, ca.v, ca.i + 0.5 t, n, (ca.i + 0.5 - 1.2) * 0.5 - 0.5 k from ca left join n using (rid)), l as (select *, least(greatest(floor(k), 0), n - 1)::bigint lo from h), j as (select l.rid, l.i, l.v, case when n is null or t < 1.2 or t > 1.2 + n / 0.5 then null else a.v + (b.v - a.v) * least(greatest(k - lo, 0), 1) end w from l left join cb a on a.rid = l.rid and a.i = l.lo left join cb b on b.rid = l.rid and b.i = least(l.lo + 1, n - 1))"


@query("interp_add", _ON_A + f" select rid, i, {s6('v + coalesce(w, 0)')} v from j")
def _(spark, d):
    a, b = two(spark, d)
    return signals.combine_times(a, b, KEY, 1.0, 0.5, delay_b=1.2).select("rid", "i", r6("v").alias("v"))


@query("interp_sub", _ON_A + f" select rid, i, {s6('v - coalesce(w, 0)')} v from j")
def _(spark, d):
    a, b = two(spark, d)
    return signals.combine_times(a, b, KEY, 1.0, 0.5, delay_b=1.2, op="-").select("rid", "i", r6("v").alias("v"))


@query("nearest_offset_add", f"with {_TWO}, cc as (select rid, i + round((rid % 7) * 0.4)::bigint i, v from cb) select coalesce(ca.rid, cc.rid) rid, coalesce(ca.i, cc.i) i, {s6('coalesce(ca.v, 0) + coalesce(cc.v, 0)')} v from ca full join cc on ca.rid = cc.rid and ca.i = cc.i")
def _(spark, d):
    a, b = two(spark, d)
    starts = pipeline.nearest_offset(F.lit(2.0), 2.0 + (F.col("rid") % 7) * 0.4, 1.0)
    return signals.combine(a, b, KEY, starts, "+", outer=True, outside_null=False).select("rid", "i", r6("v").alias("v"))


@query("create_regular_grid", f"with p as (select user_id rid, epoch_us(ts) / 3600000000.0 t, max(value) v from events group by all), s as (select *, lead(t) over w t1, lead(v) over w v1, min(t) over (partition by rid) a, max(t) over (partition by rid) z from p window w as (partition by rid order by t)), g as (select *, unnest(range(ceil((t - a) * 0.5)::bigint, least(ceil((t1 - a) * 0.5)::bigint, floor((z - a) * 0.5)::bigint))) i from s where t1 is not null) select rid, i, {s6('v + (a + i / 0.5 - t) * (v1 - v) / (t1 - t)')} v from g")
def _(spark, d):
    p = table(spark, d, "events").selectExpr("user_id rid", "unix_micros(cast(ts as timestamp)) / 3600000000D t", "value v")
    return signals.create_grid(p, KEY, 0.5).select("rid", "i", r6("v").alias("v"))


@query("derivative", f"with {_SIG}, w as (select *, lag(v) over w p, lead(v) over w q from sig window w as (partition by rid order by i)) select rid, i, {s6('coalesce((q - p) / 2, q - v, v - p)')} v from w")
def _(spark, d):
    return signals.derivative(sig(spark, d), KEY).select("rid", "i", r6("v").alias("v"))


@query("teager", f"with {_SIG}, w as (select *, lag(v) over w p, lead(v) over w q from sig window w as (partition by rid order by i)) select rid, i - 1 i, {s6('v * v - p * q')} v from w where p is not null and q is not null")
def _(spark, d):
    return signals.teager(sig(spark, d), KEY).select("rid", "i", r6("v").alias("v"))


@query("savgol_interior", f"with {_SIG}, w as (select *, (-2 * lag(v, 3) over w + 3 * lag(v, 2) over w + 6 * lag(v) over w + 7 * v + 6 * lead(v) over w + 3 * lead(v, 2) over w - 2 * lead(v, 3) over w) / 21 y from sig window w as (partition by rid order by i)) select rid, i, {s6('y')} v from w where y is not null")
def _(spark, d):
    return signals.savgol_inner(sig(spark, d), KEY).select("rid", "i", r6("v").alias("v"))


@query("fir_filter", f"with {_SIG} select rid, i, {s6('0.5 * v + 0.3 * coalesce(lag(v) over w, 0) + 0.2 * coalesce(lag(v, 2) over w, 0)')} v from sig window w as (partition by rid order by i)")
def _(spark, d):
    return signals.fir(sig(spark, d), KEY, [0.5, 0.3, 0.2]).select("rid", "i", r6("v").alias("v"))


@query("lti_absint", f"with recursive {_SIG}, f as (select rid, i, 0.0::double s, abs(v) x from sig where i = 0 union all select f.rid, sig.i, f.s * (1 - 1.0::double / 44) + f.x, abs(sig.v) from f join sig on sig.rid = f.rid and sig.i = f.i + 1) select rid, i, {s6('s / 44')} v from f")
def _(spark, d):
    return transforms.envelope(sig(spark, d), KEY, 1.0, "absint").select("rid", "i", r6("v").alias("v"))


def _bins(agg: str, having: str = "") -> str:
    return f"""with {_SIG}, {_N}, q as (select sig.*, n, n // 7 k from sig join n using (rid) where n >= 7), p as (select *, n // k q, n % k r from q)
select rid, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end i, {s6(agg)} v from p group by all"""


for _name, _agg, _sql in [
    ("bin_max", lambda: F.max("v"), "max(v)"),
    ("bin_min", lambda: F.min("v"), "min(v)"),
    ("bin_abs", lambda: F.max(F.abs("v")), "max(abs(v))"),
    ("bin_percentile95", lambda: F.percentile(F.abs("v"), F.lit(0.95)), "quantile_cont(abs(v), 0.95)"),
]:
    query(_name, _bins(_sql).replace("group by all", "group by rid, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end"))(
        lambda spark, d, _agg=_agg: signals.bins(sig(spark, d), KEY, 7, _agg()).select("rid", "i", r6("v").alias("v"))
    )

for _name, _kw, _sql in [
    ("normalize_absmax", {"method": "absmax"}, "v / nullif(max(abs(v)) over (partition by rid), 0)"),
    ("normalize_meanstd", {"method": "meanstd"}, "(v - avg(v) over (partition by rid)) / nullif(stddev_pop(v) over (partition by rid), 0)"),
    ("normalize_alphabeta", {"method": "alphabeta", "alpha": 0.5, "beta": 2.0}, "(v - 0.5 * avg(v) over (partition by rid)) / nullif(pow(stddev_pop(v) over (partition by rid), 2), 0)"),
]:
    query(_name, f"with {_SIG} select rid, i, {s6(_sql)} v from sig")(lambda spark, d, _kw=_kw: signals.normalize(sig(spark, d), KEY, **_kw).select("rid", "i", r6("v").alias("v")))

for _name, _largest, _by in [("time_max", True, "v desc, i"), ("time_min", False, "v, i")]:
    query(_name, f"with {_SIG} select rid, i + 0.5 \"time\" from sig qualify row_number() over (partition by rid order by {_by}) = 1")(lambda spark, d, _l=_largest: signals.extremum(sig(spark, d), KEY, _l))


@query("feature_one_pass", f"with {_SIG} select rid, count(*) n, {s6('sum(abs(v))')} abs_sum, {s6('sum(v * v)')} energy, {s6('sqrt(avg(v * v))')} rms, {s6('max(abs(v))')} peak, {s6('avg(v)')} mean, {s6('stddev_pop(v)')} std from sig group by rid")
def _(spark, d):
    f = signals.features(sig(spark, d), KEY)
    return f.select("rid", "n", *[r6(c).alias(c) for c in ("abs_sum", "energy", "rms", "peak", "mean", "std")])


_CUT = "cut as (select a.rid, a.annot_id, sig.i - a.\"start\"::bigint k, sig.v from a join sig on sig.rid = a.rid and sig.i >= a.\"start\" and sig.i < a.\"end\")"


@query("calculate_annotations", f"with {_SIG}, {_A}, {_CUT} select rid, annot_id, count(*) n, {s6('sum(abs(v))')} abs_sum, {s6('sum(v * v)')} energy, {s6('max(abs(v))')} peak from cut group by rid, annot_id")
def _(spark, d):
    s = sig(spark, d)
    f = signals.features(signals.annotation_samples(s, intervals.segment_islands(s, 20, 60)), ["rid", "annot_id"])
    return f.select("rid", "annot_id", "n", r6("abs_sum").alias("abs_sum"), r6("energy").alias("energy"), r6("peak").alias("peak"))


@query("robust_threshold", f"with {_SIG}, m as (select rid, median(v) med from sig group by rid), t as (select rid, med, median(abs(v - med)) mad from sig join m using (rid) group by rid, med) select rid, {s6('med')} median, {s6('mad')} mad, {s6('med + 2 * 4 * mad / 0.6745')} threshold from t")
def _(spark, d):
    return signals.robust_threshold(sig(spark, d), KEY, 2.0).select("rid", r6("median").alias("median"), r6("mad").alias("mad"), r6("threshold").alias("threshold"))


# ---- correlation --------------------------------------------------------------------------------------------------

TEMPLATE = [10.0, 40.0, 90.0, 40.0, 10.0]
_T = "tpl as (select * from (values (0, 10.0::double), (1, 40.0), (2, 90.0), (3, 40.0), (4, 10.0)) x(j, t)), ts as (select avg(t) m, stddev_pop(t) s, sum(t * t) tt from tpl)"
_WIN = f"{_SIG}, {_T}, win as (select a.rid, a.i - j i, count(*) c, sum(v * (t - m) / s) dz, sum(v * t) dt, sum(v) s1, sum(v * v) s2, any_value(tt) tt from sig a, tpl, ts group by a.rid, a.i - j having count(*) = 5)"

for _name, _kw, _sql in [
    ("pearson_valid", {"method": "pearson"}, "case when 5 * s2 - s1 * s1 > 1e-9 then dz / sqrt(5 * s2 - s1 * s1) end"),
    ("pearson_global", {"method": "pearson_global"}, "dt / 5"),
    ("similitude_ned", {"method": "similitude"}, "(1 - sqrt(greatest(1 - 2 * dt / (s2 + tt), 0))) / (1 + sqrt(greatest(1 - 2 * dt / (s2 + tt), 0)))"),
    ("similitude_sned", {"method": "similitude", "distance": "SNED", "similitude": "1/(1+d)"}, "1 / (1 + 1 - 2 * dt / (s2 + tt))"),
]:
    query(_name, f"with {_WIN} select rid, i, {s6(_sql)} v from win")(lambda spark, d, _kw=_kw: correlate.sliding(sig(spark, d), KEY, TEMPLATE, **_kw).select("rid", "i", r6("v").alias("v")))

_PADDED = "pd as (select rid, i + {b} i, v from sig union all select rid, g, 0.0::double from n, lateral (select unnest(range(0, {b})) g union all select unnest(range(n + {b}, n + {b} + {e})) g) t)"
for _name, _mode, _b, _e in [("pearson_full", "full", 4, 4), ("pearson_same", "same", 2, 2)]:
    query(_name, f"with {_SIG}, {_N}, {_PADDED.format(b=_b, e=_e)}, {_T}, win as (select a.rid, a.i - j i, count(*) c, sum(v * (t - m) / s) dz, sum(v) s1, sum(v * v) s2 from pd a, tpl, ts group by a.rid, a.i - j having count(*) = 5) select rid, i, {s6('case when 5 * s2 - s1 * s1 > 1e-9 then dz / sqrt(5 * s2 - s1 * s1) end')} v from win")(
        lambda spark, d, _m=_mode: correlate.sliding(sig(spark, d), KEY, TEMPLATE, mode=_m).select("rid", "i", r6("v").alias("v"))
    )

_R = "case when n * sxx - sx * sx > 1e-9 and n * syy - sy * sy > 1e-9 then (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) end"


@query("aligned_cor", f"with {_TWO}, g as (select ca.rid, count(*) n, sum(ca.v) sx, sum(cb.v) sy, sum(ca.v * cb.v) sxy, sum(ca.v * ca.v) sxx, sum(cb.v * cb.v) syy from ca join cb on ca.rid = cb.rid and ca.i = cb.i group by ca.rid) select rid, n, {s6(_R)} r from g")
def _(spark, d):
    return correlate.aligned(*two(spark, d), KEY).select("rid", "n", r6("r").alias("r"))


@query("corspe_parallel", f"with {_TWO}, x as (select ca.*, unnest(range(greatest(ceil((i - 7) / 4.0), 0)::bigint, i // 4 + 1)) w from ca), y as (select x.rid, w * 4 c, lag, x.v x, cb.v y from x, (select unnest(range(-2, 3)) lag) l, cb where cb.rid = x.rid and cb.i = x.i + lag), g as (select rid, c, lag, count(*) n, sum(x) sx, sum(y) sy, sum(x * y) sxy, sum(x * x) sxx, sum(y * y) syy from y group by all) select rid, c, lag, {s6(_R)} r from g where n = 8")
def _(spark, d):
    return correlate.lagged(*two(spark, d), KEY, 8, 4, 2).select("rid", "c", "lag", r6("r").alias("r"))


_LAG = "x as (select ca.*, unnest(range(greatest(ceil((i - 7) / 4.0), 0)::bigint, i // 4 + 1)) w from ca), y as (select x.rid, w * 4 c, lag, x.v x, cb.v y from x, (select unnest(range(-2, 3)) lag) l, cb where cb.rid = x.rid and cb.i = x.i + lag), g as (select rid, c, lag, count(*) n, sum(x * y) sxy, sum(x * x) sxx, sum(y * y) syy from y group by all)"
_NED = "sqrt(greatest(1 - 2 * sxy / (sxx + syy), 0))"


@query("corspe_similitude", f"with {_TWO}, {_LAG} select rid, c, lag, {s6(f'(1 - {_NED}) / (1 + {_NED})')} r from g where n = 8")
def _(spark, d):
    return correlate.lagged(*two(spark, d), KEY, 8, 4, 2, "similitude").select("rid", "c", "lag", r6("r").alias("r"))


@query("corspe_orthogonal", f"with {_TWO}, t as (select cb.*, unnest(range(greatest(ceil((i - 3) / 3.0), 0)::bigint, i // 3 + 1)) w from cb), g as (select t.rid, w * 3 c, ca.i - (t.i - w * 3) i, count(*) n, sum(t.v) sx, sum(ca.v) sy, sum(t.v * ca.v) sxy, sum(t.v * t.v) sxx, sum(ca.v * ca.v) syy from t join ca on ca.rid = t.rid and t.i - w * 3 between 0 and 3 group by all) select rid, c, i, {s6(_R)} r from g where n = 4 and i >= 0")
def _(spark, d):
    return correlate.orthogonal(*two(spark, d), KEY, 4, 3).select("rid", "c", "i", r6("r").alias("r"))


@query("dft_power_small", f"with {_SIG}, fr as (select rid, i // 8 seg, i % 8 j, v from sig), ok as (select rid, seg from fr group by all having count(*) = 8), z as (select fr.rid, fr.seg, f, sum(v * cos(-2 * pi() * (j * f % 8) / 8)) re, sum(v * sin(-2 * pi() * (j * f % 8) / 8)) im from fr join ok using (rid, seg), (select unnest(range(0, 5)) f) t group by all) select rid, seg, f, {s6('re * re + im * im')} power from z")
def _(spark, d):
    f = sig(spark, d).select("rid", F.floor(F.col("i") / 8).alias("seg"), (F.col("i") % 8).alias("j"), "v")
    full = f.groupBy("rid", "seg").count().where("count = 8").drop("count")
    return correlate.dft_power(f.join(full, ["rid", "seg"], "left_semi"), ["rid", "seg"], 8).select("rid", "seg", "f", r6("power").alias("power"))


@query("spe_correlate", f"with {_SIG}, sp as (select rid, i // 4 seg, i % 4 f, v p from sig), tpl as (select s seg, f, s * 10.0 + f * f * 7.0 q from (select unnest(range(0, 3)) s), (select unnest(range(0, 4)) f)), ts as (select avg(q) m, stddev_pop(q) sd from tpl), g as (select rid, sp.seg - tpl.seg seg, count(*) n, sum(p * (q - m) / sd) dot, sum(p) s1, sum(p * p) s2 from sp join tpl on sp.f = tpl.f, ts group by all) select rid, seg, {s6('case when 12 * s2 - s1 * s1 > 1e-12 then dot / sqrt(12 * s2 - s1 * s1) end')} r from g where n = 12")
def _(spark, d):
    sp = sig(spark, d).select("rid", F.floor(F.col("i") / 4).alias("seg"), (F.col("i") % 4).alias("f"), F.col("v").alias("p"))
    t = spark.createDataFrame([(s, f, s * 10.0 + f * f * 7.0) for s in range(3) for f in range(4)], "seg bigint, f bigint, q double")
    return correlate.spectrogram_match(sp, t, KEY).select("rid", "seg", r6("r").alias("r"))


# ---- ensembles ----------------------------------------------------------------------------------------------------

_ENS = "ens as (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) - 1 k from embeddings)"


def ens_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("values"))


def ens(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.long_rows(ens_rows(spark, d), ["vec_id"])


for _name, _sql in [
    ("mean", "avg(v)"), ("median", "median(v)"), ("std", "stddev_pop(v)"), ("var", "var_pop(v)"), ("average", "avg(v)"), ("cv", "stddev_pop(v) / nullif(avg(v), 0)"), ("eta2", "var_pop(v) / nullif(avg(v) * avg(v), 0)"),
]:
    query(f"ens_{_name}", f"with {_ENS} select k, {s6(_sql)} v from ens group by k")(lambda spark, d, _n=_name: ensemble.statistics(ens(spark, d)).select("k", r6(_n).alias("v")))

for _name, _kw, _sql in [
    ("meanstd", {}, "(v - avg(v) over (partition by vec_id)) / nullif(stddev_pop(v) over (partition by vec_id), 0)"),
    ("alphabeta", {"method": "alphabeta", "alpha": 0.5, "beta": 1.0}, "(v - 0.5 * avg(v) over (partition by vec_id)) / nullif(stddev_pop(v) over (partition by vec_id), 0)"),
]:
    query(f"ens_normalize_{_name}", f"with {_ENS} select vec_id, k, {s6(_sql)} v from ens")(
        lambda spark, d, _kw=_kw: ensemble.long_rows(ensemble.normalize(ens_rows(spark, d), **_kw), ["vec_id"]).select("vec_id", "k", r6("v").alias("v"))
    )


@query("ens_sort", "select vec_id, label from embeddings order by label desc nulls last, vec_id")
def _(spark, d):
    return ensemble.sort_rows(ens_rows(spark, d).select("vec_id", "label"), "label", False, ["vec_id"])


@query("ens_subset", "select vec_id, label from embeddings where label in (1, 3) and vec_id > 10")
def _(spark, d):
    from ..functions.query import to_sql

    return ens_rows(spark, d).where(to_sql("(label in [1, 3]) & (vec_id > @low)", {"low": 10})).select("vec_id", "label")


@query("ens_get", f"with {_ENS} select vec_id, k, v from ens where vec_id = (select min(vec_id) from embeddings where label = 2)")
def _(spark, d):
    return ensemble.long_rows(ensemble.first_row(ens_rows(spark, d), "label = 2", ["vec_id"]), ["vec_id"])


@query("ens_long_uaid", f"with {_ENS} select vec_id record_id, label annot_id, (vec_id * 100 + label)::varchar uaid, k, (k + 0.5) / 8 \"time\", v from ens")
def _(spark, d):
    e = ensemble.long_rows(ens_rows(spark, d), ["vec_id", "label"])
    return e.select(F.col("vec_id").alias("record_id"), F.col("label").alias("annot_id"), (F.col("vec_id") * 100 + F.col("label")).cast("string").alias("uaid"), "k", ((F.col("k") + 0.5) / 8).alias("time"), "v")


@query("nan_remove", "select vec_id from embeddings where not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x)))")
def _(spark, d):
    return ensemble.nan_remove(ens_rows(spark, d)).select("vec_id")


@query("ens_vstack", "select vec_id, label from embeddings where label < 5 union all select vec_id, label from embeddings where label >= 3")
def _(spark, d):
    e = ens_rows(spark, d).select("vec_id", "label")
    return ensemble.vstack([e.where("label < 5"), e.where("label >= 3")])


@query("rows_in_both", "select vec_id, label from embeddings where label < 5 intersect select vec_id, label from embeddings where label >= 3")
def _(spark, d):
    e = ens_rows(spark, d).select("vec_id", "label")
    return ensemble.rows_in_both(e.where("label < 5"), e.where("label >= 3"))


@query("rows_only_in_first", "select event_type, user_id from events where value < 300 except all select event_type, user_id from events where value > 100")
def _(spark, d):
    e = table(spark, d, "events")
    return ensemble.rows_only_in_first(e.where("value < 300").select("event_type", "user_id"), e.where("value > 100").select("event_type", "user_id"))


@query("ens_hstack_crossfade", f"with {_ENS}, w as (select vec_id, k, v from ens where k < 60 union all select vec_id, k + 64, v from ens where k >= 4), x as (select a.vec_id, a.k, a.v * (1 - (0.25 + (a.k - 60) * 0.1875)) + b.v * (0.25 + (a.k - 60) * 0.1875) v from ens a join ens b on a.vec_id = b.vec_id and a.k >= 60 and b.k = a.k - 60) select vec_id, case when k >= 64 then k - 4 else k end k, {s6('v')} v from (select vec_id, k, v from w union all select * from x)")
def _(spark, d):
    e = ens_rows(spark, d)
    return ensemble.long_rows(ensemble.hstack(e, e, ["vec_id"], 4), ["vec_id"]).select("vec_id", "k", r6("v").alias("v"))


@query("ens_add", f"with {_ENS} select coalesce(a.vec_id, b.vec_id) vec_id, coalesce(a.k, b.k + 5) k, {s6('coalesce(a.v, 0) + coalesce(b.v, 0)')} v from ens a full join ens b on a.vec_id = b.vec_id and a.k = b.k + 5")
def _(spark, d):
    e = ens(spark, d)
    return ensemble.add(e, ens(spark, d), ["vec_id"], 5).select("vec_id", "k", r6("v").alias("v"))


@query("get_ensemble", f"with {_SIG}, {_A}, {_CUT}, top as (select max(k) t from cut), g as (select rid, annot_id, unnest(range(0, t + 1)) k from (select distinct rid, annot_id from cut), top) select g.rid, g.annot_id, g.k, coalesce(cut.v, 0) v from g left join cut on g.rid = cut.rid and g.annot_id = cut.annot_id and g.k = cut.k")
def _(spark, d):
    s = sig(spark, d)
    return ensemble.build(signals.annotation_samples(s, intervals.segment_islands(s, 20, 60)), ["rid", "annot_id"])


@query("ens_zeros", "select vec_id, unnest(range(0, 7)) k, 0.0::double v from embeddings where label = 1")
def _(spark, d):
    return ensemble.zeros(ens_rows(spark, d).where("label = 1"), ["vec_id"], 7)


@query("dejitter")
def _(spark, d):
    return ensemble.dejitter(ens(spark, d), ["vec_id"], 3)


@query("sample_n")
def _(spark, d):
    return ensemble.sample(ens_rows(spark, d).select("vec_id", "label"), 50, 7, order=["vec_id"])


@query("bootstrap")
def _(spark, d):
    return ensemble.sample(ens_rows(spark, d).select("vec_id", "label"), 200, 7, True, ["vec_id"])


# ---- pitch points -------------------------------------------------------------------------------------------------

def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id rid", "concat(cast(to_date(ts) as string), event_type) syl", "unix_micros(cast(ts as timestamp)) / 3600000000D - 473352D time", "value freq", "1 + event_id % 3 harmonic")


@query("silence_fill", f"with p as (select user_id rid, strftime(ts, '%Y-%m-%d') || event_type syl, epoch_us(ts) / 3600000000.0 - 473352.0 t, value f from events), s as (select rid, syl, min(t) a, max(t) b from p group by all), g as (select *, lag(b) over (partition by rid order by a, syl) p from s), x as (select rid, p + unnest(range(1, ceil((a - p) / 2 - 1e-9)::bigint)) * 2.0 t from g where a - p > 4) select rid, syl, {s6('t')} \"time\", f freq from p union all select rid, '', {s6('t')}, 0 from x")
def _(spark, d):
    p = pitch.silence_fill(points(spark, d), KEY, 0.0, 2.0)
    return p.select("rid", "syl", r6("time").alias("time"), "freq")


@query("db2fund", f"with p as (select user_id rid, epoch_us(ts) / 3600000000.0 - 473352.0 t, max(value / (1 + event_id % 3)) v from events group by all), s as (select *, lead(t) over w t1, lead(v) over w v1, min(t) over (partition by rid) a, max(t) over (partition by rid) z from p window w as (partition by rid order by t)), g as (select *, unnest(range(ceil((t - a) * 0.25)::bigint, least(ceil((t1 - a) * 0.25)::bigint, floor((z - a) * 0.25)::bigint))) i from s where t1 is not null) select rid, i, {s6('v + (a + i / 0.25 - t) * (v1 - v) / (t1 - t)')} v from g")
def _(spark, d):
    return pitch.fundamental(points(spark, d), KEY, 0.25).select("rid", "i", r6("v").alias("v"))


# ---- array transforms (no SQL: checked against closed forms in the tests) -----------------------------------------


def _powers(hop: int, window: str, detrend: bool, scale: str) -> str:
    """Powers by segment and frequency of frames of 16 samples at 100 Hz, as sums of sines: pw(rid, seg, f, p)."""
    v = "(v - mean)" if detrend else "v"
    return f"""{_SIG}, wn as (select j, {window} w from (select unnest(range(0, 16)) j)), ws as (select sum(w) sw, sum(w * w) sww from wn),
fr as (select rid, (i - j) // {hop} seg, j, v, w, avg(v) over g mean, count(*) over g c from sig, wn where i >= j and (i - j) % {hop} = 0 window g as (partition by rid, (i - j) // {hop})),
z as (select rid, seg, f, sum({v} * w * cos(2 * pi() * (j * f % 16) / 16)) re, sum({v} * w * sin(2 * pi() * (j * f % 16) / 16)) im from fr, (select unnest(range(0, 9)) f) where c = 16 group by all),
pw as (select rid, seg, f, (re * re + im * im) * case when f in (0, 8) then 1 else 2 end * {scale} p from z, ws)"""


_EPS = "2.220446049250313e-16"
_HANN, _HANNING = "0.5 - 0.5 * cos(2 * pi() * j / 16)", "0.5 - 0.5 * cos(2 * pi() * j / 15)"
_BARTHANN = "0.62 - 0.48 * abs(j / 16.0::double - 0.5) + 0.38 * cos(2 * pi() * (j / 16.0::double - 0.5))"
_GAUSS = "exp(-0.5 * power((j - 8) / 16.0::double, 2))"


def _log_powers(hop: int, window: str, detrend: bool, scale: str, keep: float | None = None, shift: float = 0.0) -> str:
    floor = f"greatest(p, {_EPS})" if keep is None else f"greatest(p, max(p) over (partition by rid) * power(10, -{keep / 10}::double), {_EPS})"
    return f"with {_powers(hop, window, detrend, scale)} select rid, seg, {s6(f'(seg * {hop} + 8) / 100.0::double + {shift}')} t, f freq_idx, {s6('f * 6.25')} freq, {s6(f'log10({floor})')} log10_power from pw"


_DENSITY, _SPECTRUM = "1 / (100 * sww)", "1 / (sw * sw)"
SPECTRA = {
    "scipy": _log_powers(8, _BARTHANN, True, _SPECTRUM),
    "scipy_praat": _log_powers(2, _GAUSS, True, _DENSITY, 70),  # the overlap of signals of fewer than 2,000 samples
    "mlab": _log_powers(8, _HANNING, False, _DENSITY),
    "mlab_praat": _log_powers(8, _HANNING, False, _DENSITY, 70),
}
_HILBERT = f"""with {_SIG}, {_N}, h as (select a.rid, a.i, any_value(a.v) v, sum(b.v * case when t = 0 then 0 when n % 2 = 0 then case when t % 2 = 1 then 2 / tan(pi() * t / n) / n else 0 end when t % 2 = 1 then 1 / tan(pi() * t / (2 * n)) / n else -tan(pi() * t / (2 * n)) / n end) y
from sig a join n using (rid) join sig b on a.rid = b.rid, lateral (select (a.i - b.i + n) % n t) group by a.rid, a.i) select rid, i, {s6('sqrt(v * v + y * y)')} v from h"""


def _arrays():
    t, rate = transforms, 100.0
    made = {
        "butter_lowpass": lambda s: t.butter(s, KEY, rate, high=10.0),
        "butter_highpass": lambda s: t.butter(s, KEY, rate, low=10.0),
        "butter_bandpass": lambda s: t.butter(s, KEY, rate, 5.0, 20.0),
        "butter_bandstop": lambda s: t.butter(s, KEY, rate, 20.0, 5.0),
        "butter_causal": lambda s: t.butter(s, KEY, rate, high=10.0, causal=True),
        "decimate": lambda s: t.decimate(s, KEY, 4),
        "smooth_savgol": lambda s: t.smooth(s, KEY),
        "match_nms": lambda s: t.match(correlate.sliding(s, KEY, TEMPLATE), KEY, len(TEMPLATE), 1.0, 0.6),
    }
    for m in ("scipy", "scipy_praat", "mlab", "mlab_praat"):
        a = {"nperseg": 16, "noverlap": 8} if m == "scipy" else {"nfft": 16, "noverlap": 8} if m == "mlab" else {"window_length": 0.08}
        query(f"spectrogram_{m}", SPECTRA[m])(lambda spark, d, m=m, a=a: t.spectrogram(sig(spark, d), KEY, rate, m, **a).select("rid", "seg", r6("t").alias("t"), "freq_idx", r6("freq").alias("freq"), r6("log10_power").alias("log10_power")))

    @query("spectrogram_tlim", _log_powers(8, _BARTHANN, True, _SPECTRUM, shift=0.1).replace(_SIG, _SIG.replace("sig as", "every as") + ", sig as (select rid, i - 10 i, v from every where i >= 10 and i < 50)"))
    def _(spark, d):
        g = t.spectrogram(sig(spark, d), KEY, rate, "scipy", (0.1, 0.5), nperseg=16, noverlap=8)
        return g.select("rid", "seg", r6("t").alias("t"), "freq_idx", r6("freq").alias("freq"), r6("log10_power").alias("log10_power"))

    for m in ("robust", "robust_teager", "log_robust_teager", "jarne", "mindlin"):
        a = {"sg_window": 9} if m == "mindlin" else {"bin_size": 5, "cut_freq": 4.0}
        made[f"envelope_{m}"] = lambda s, m=m, a=a: t.envelope(s, KEY, rate, m, **a)
    for name, f in made.items():
        query(name)(lambda spark, d, f=f: f(sig(spark, d)))

    @query("hilbert", _HILBERT)
    def _(spark, d):
        return t.hilbert(sig(spark, d), KEY).select("rid", "i", r6("v").alias("v"))

    @query("welch", f"with {_powers(8, _HANN, True, _DENSITY)} select rid, f freq_idx, {s6('f * 6.25')} freq, {s6('avg(p)')} power from pw group by rid, f")
    def _(spark, d):
        return t.welch(sig(spark, d), KEY, rate, 16).select("rid", "freq_idx", r6("freq").alias("freq"), r6("power").alias("power"))

    @query("envelope_binmap", _bins("max_by(v, i) - min_by(v, i)").replace("group by all", "group by rid, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end"))
    def _(spark, d):
        return t.envelope(sig(spark, d), KEY, rate, "binmap", bin_size=7, func=lambda x: float(x[-1] - x[0])).select("rid", "i", r6("v").alias("v"))

    @query("envelope_function", f"with {_SIG} select rid, i, {s6('pi() * abs(v - avg(v) over (partition by rid))')} v, 50.0::double env_rate from sig")
    def _(spark, d):
        e = t.envelope(sig(spark, d), KEY, rate, lambda x: abs(x - x.mean()), env_rate=50.0)
        return e.select("rid", "i", r6(F.pi() * F.col("v")).alias("v"), "env_rate")

    @query("apply_function", f"with {_SIG} select rid, i // 2 i, {s6('sum(v) over (partition by rid order by i)')} v, null::varchar error from sig where i % 2 = 0")
    def _(spark, d):
        return t.apply(sig(spark, d), KEY, lambda x: x[::2].cumsum()).select("rid", "i", r6("v").alias("v"), "error")

    @query("lfilter_iir", f"with recursive {_SIG}, f as (select rid, i, 0.2 * v y from sig where i = 0 union all select f.rid, sig.i, 0.2 * sig.v + 0.8 * f.y from f join sig on sig.rid = f.rid and sig.i = f.i + 1) select rid, i, {s6('y')} v from f")
    def _(spark, d):
        return t.lfilter(sig(spark, d), KEY, [0.2], [1.0, -0.8]).select("rid", "i", r6("v").alias("v"))

    @query("lfilter_sum", f"with {_SIG} select rid, i, {s6('sum(v) over (partition by rid order by i)')} v from sig")
    def _(spark, d):
        return t.lfilter(sig(spark, d), KEY, [1.0], [1.0, -1.0]).select("rid", "i", r6("v").alias("v"))

    for m, sql in [("binmax", "max(v)"), ("binmin", "min(v)"), ("binabs", "max(abs(v))"), ("robust95", "quantile_cont(abs(v), 0.95)")]:
        query(f"envelope_{m}", _bins(sql).replace("group by all", "group by rid, case when i < r * (q + 1) then i // (q + 1) else r + (i - r * (q + 1)) // q end").replace(" from p ", ", 14.285714 env_rate from p "))(
            lambda spark, d, m=m: t.envelope(sig(spark, d), KEY, rate, m.removesuffix("95"), bin_size=7).select("rid", "i", r6("v").alias("v"), F.round("env_rate", 6).alias("env_rate"))
        )

    @query("envelope_teager", f"with {_SIG}, w as (select *, lag(v) over w p, lead(v) over w q from sig window w as (partition by rid order by i)) select rid, i - 1 i, {s6('v * v - p * q')} v, 100.0::double env_rate from w where p is not null and q is not null")
    def _(spark, d):
        return t.envelope(sig(spark, d), KEY, rate, "teager").select("rid", "i", r6("v").alias("v"), "env_rate")

    @query("envelope_absint", f"with recursive {_SIG}, f as (select rid, i, 0.0::double s, abs(v) x from sig where i = 0 union all select f.rid, sig.i, f.s * (1 - 1.0::double / 30) + f.x, abs(sig.v) from f join sig on sig.rid = f.rid and sig.i = f.i + 1) select rid, i, {s6('s / 30')} v from f")
    def _(spark, d):
        return t.envelope(sig(spark, d), KEY, rate, "absint", tau=30).select("rid", "i", r6("v").alias("v"))

    @query("nmf_lag")
    def _(spark, d):
        m = table(spark, d, "events").select("event_type", (F.hour("ts")).alias("t"), "value").groupBy(F.lit(0).alias("g"), F.hash("event_type").alias("row"), "t").agg(F.sum("value").alias("y"))
        return t.nmf(m, ["g"], 2, lags=1)

    def pairs(spark, d):
        a, b = two(spark, d)
        return a.join(b.withColumnRenamed("v", "y"), ["rid", "i"]).withColumnRenamed("v", "x")

    @query("stw")
    def _(spark, d):
        return t.stw(pairs(spark, d), KEY, 100.0)

    @query("stw_summary")
    def _(spark, d):
        return t.warp_summary(t.stw(pairs(spark, d), KEY, 100.0), KEY)

    @query("warp_given")
    def _(spark, d):
        return t.warped(sig(spark, d), KEY, 100.0, "[[0 0.2 0.4 0.9] [0.01 0.02 0 -0.01]]")

    def song(spark, d):
        return ensemble.long_rows(ens_rows(spark, d), ["vec_id"]).select("vec_id", F.col("k").alias("i"), F.abs("v").alias("env"), F.lit(900.0).alias("fund"))

    table_of_betas = ([400.0, 900.0, 2000.0], [-0.4, -0.1, 0.05])

    @query("finch")
    def _(spark, d):
        return t.finch(song(spark, d), ["vec_id"], 44150.0, table_of_betas)

    @query("finch_two_sources")
    def _(spark, d):
        return t.finch(song(spark, d), ["vec_id"], 44150.0, table_of_betas, 0.9)

    @query("finch_unfiltered")
    def _(spark, d):
        return t.finch(song(spark, d).withColumn("beta", F.lit(-0.1)), ["vec_id"], 44150.0, filtered=False)

    @query("finch_fir")
    def _(spark, d):
        return t.lfilter(sig(spark, d), KEY, pitch.tract_taps(44150.0, 101))


_arrays()

_TUBE = "0.9::double / sqrt(1 + 0.2 * cos(4 * pi() * f * 4 / 35000) + 0.01)"
_CH = "(0.8e-8::double / 360)"
_CAVITY = f"w * w * {_CH} * 82 / (power({_CH} * 6e5 * w, 2) + 1)"


@query("tract_magnitude", f"with g as (select i, i * 22.075::double f, 2 * pi() * i * 22.075 w from (select unnest(range(0, 1001)) i)), k as (select *, {_CAVITY} k from g) select i, {s6(f'{_TUBE} / sqrt(power(0.5e7 - k * (0.5e7 + 1e4 * {_CH} * 6e5 * w * w), 2) + power(w * 10082 + k * w * (0.5e7 * {_CH} * 6e5 - 1e4), 2)) * 1e7')} gain from k")
def _(spark, d):
    return spark.range(1001).select(F.col("id").alias("i"), r6(pitch.tract_gain(F.col("id") * 22.075) * 1e7).alias("gain"))
