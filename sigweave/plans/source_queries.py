"""Round trips through every source and sink, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import transforms
from ..operators.common import shared_dir
from ..operators.ordered import explode_signal
from ..sources import folders, tables, wav
from ..sources.files import write_files
from .reference_queries import _ANN, _SIG, KEY, annots, ens_rows, r6, s6, sig, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def arrays(spark, d):
    """file, rate, samples of each user's signal."""
    s = sig(spark, d).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("samples"))
    return s.select("rid", F.concat(F.lit("u"), "rid", F.lit(".wav")).alias("file"), F.lit(8000.0).alias("rate"), "samples")


@query("wav_roundtrip", f"with {_SIG}, t as (select *, max(abs(v)) over (partition by rid) top from sig) select 'u' || rid || '.wav' file, i, {s6('round(v / top * 0.999 * 32766) / 32768 * top / 0.999')} v from t")
def _(spark, d):
    where = shared_dir(spark, "wav")
    log = wav.write_wav(arrays(spark, d), where)
    back = wav.read_wav(spark, where, log, part_samples=50)
    return back.select("file", "first", F.posexplode("samples").alias("k", "v")).select("file", (F.col("first") + F.col("k")).alias("i"), r6("v").alias("v"))


@query("wav_headers", f"with {_SIG} select 'u' || rid || '.wav' file, 8000.0::double rate, 1 channels, count(*) n_samples, 'float32' format from sig group by rid")
def _(spark, d):
    where = shared_dir(spark, "wav")
    wav.write_wav(arrays(spark, d), where, normalize=False, sample_format="float32")
    return wav.read_wav(spark, where, header_only=True).select("file", "rate", "channels", "n_samples", "format")


@query("wav_filter_chain", f"with recursive {_SIG}, q as (select rid, i, (v::float)::double v from sig), f as (select rid, i, 0.2 * v y from q where i = 0 union all select f.rid, q.i, 0.2 * q.v + 0.8 * f.y from f join q on q.rid = f.rid and q.i = f.i + 1), g as (select rid, i, y + coalesce(lag(y) over (partition by rid order by i), 0) z from f) select 'u' || rid || '.wav' file, i, {s6('z')} v from g")
def _(spark, d):
    where = shared_dir(spark, "wav")
    wav.write_wav(arrays(spark, d), where, normalize=False, sample_format="float32")
    parts = wav.read_wav(spark, where, part_samples=50).select("file", "first", "samples")
    y = transforms.lfilter(transforms.lfilter(parts, ["file"], [0.2], [1.0, -0.8]), ["file"], [1.0, 1.0])
    return explode_signal(y, ["file"]).select("file", "i", r6("v").alias("v"))


def typed(spark, d):
    a = annots(spark, d).withColumn("comment", F.coalesce(F.regexp_replace("comment", r"[\t\r\n]", " "), F.lit("none")))
    return a.withColumn("annot_type", F.when(F.col("record_id") % 2 == 0, "even").otherwise("odd"))


_TYPED = f"{_ANN}, ty as (select record_id, annot_id, \"start\", \"end\", coalesce(regexp_replace(comment, '[\\t\\r\\n]', ' ', 'g'), 'none') comment, case when record_id % 2 = 0 then 'even' else 'odd' end annot_type from ann)"


@query("annot_tsv_roundtrip", f"with {_TYPED} select record_id, annot_id, {s6('\"start\"')} \"start\", {s6('\"end\"')} \"end\", comment, annot_type from ty")
def _(spark, d):
    where = shared_dir(spark, "annots")
    tables.write_annotations(typed(spark, d), where)
    a = tables.read_written_annotations(spark, where)
    return a.select("record_id", "annot_id", r6("start").alias("start"), r6("end").alias("end"), "comment", "annot_type")


def written(spark, d):
    where = shared_dir(spark, "records")
    a = arrays(spark, d)
    records = a.select(F.col("rid").alias("record_id"), F.lit("x").alias("rig"), F.size("samples").alias("n"))
    signals = a.select(F.col("rid").alias("record_id"), F.lit("s").alias("channel"), "rate", "samples")
    notes = a.select(F.col("rid").alias("record_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("annot_id")).selectExpr("record_id", "annot_id", "annot_id * 0.5D start", "if(annot_id = 2, null, annot_id + 1D) end", "concat('c', annot_id) comment", "if(annot_id = 0, 'one', 'more') annot_type")
    folders.write_record_folder(records, signals, notes, where)
    return where


@query("record_folder_signals", f"with {_SIG} select rid record_id, 's' channel, i, {s6('v::float')} v from sig")
def _(spark, d):
    _, s, _ = folders.read_record_folder(spark, written(spark, d))
    return s.select("record_id", "channel", "first", F.posexplode("samples").alias("k", "v")).select("record_id", "channel", (F.col("first") + F.col("k")).alias("i"), r6("v").alias("v"))


@query("record_folder_tables", f"with {_SIG}, r as (select rid, count(*) n from sig group by rid) select rid record_id, 'x' rig, n, a annot_id, a * 0.5::double \"start\", case when a < 2 then a + 1.0::double end \"end\", 'c' || a comment, case when a = 0 then 'one' else 'more' end annot_type from r, (select unnest([0, 1, 2])::bigint a) t")
def _(spark, d):
    rec, _, notes = folders.read_record_folder(spark, written(spark, d))
    rec = rec.select("record_id", F.try_element_at("values", F.lit("rig")).alias("rig"), F.try_element_at("values", F.lit("n")).cast("bigint").alias("n"))
    return rec.join(notes, "record_id").select("record_id", "rig", "n", "annot_id", "start", "end", "comment", "annot_type")


@query("matrix_roundtrip", f"select 'm' || (vec_id % 3) \"name\", vec_id, label, list_aggregate(embedding, 'sum')::double > 0 positive, {s6('embedding[1]')} first_value, 63.0::double last_time from embeddings")
def _(spark, d):
    where = shared_dir(spark, "matrix")
    m = ens_rows(spark, d).select(F.concat(F.lit("m"), F.col("vec_id") % 3).alias("name"), F.col("vec_id").alias("row"), F.col("label").cast("string").alias("y"), "values", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda x: x.cast("double")).alias("times"), F.lit(0.5).alias("tjust"), "vec_id", "label")
    folders.write_npz(m, where)
    b = folders.read_matrix_rows(spark, where, "vec_id bigint, label int")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return b.select("name", "vec_id", "label", (total > 0).alias("positive"), r6(F.col("values")[0]).alias("first_value"), F.element_at("times", -1).alias("last_time"))


@query("folder_tree_scan", f"with {_SIG}, r as (select rid, count(*) n from sig group by rid) select 20240000000000 + rid record_id, 's' channel, 'u' || rid || '.wav' file, row_number() over (order by 'd' || (rid % 3), 'u' || rid || '.wav') - 1 file_id, n / 8000.0::double duration, rid / 10.0::double delay from r")
def _(spark, d):
    where = shared_dir(spark, "tree")
    a = arrays(spark, d).withColumn("folder", F.concat(F.lit("d"), F.col("rid") % 3))
    wav.write_wav(a.withColumn("file", F.concat("folder", F.lit("/"), "file")), where, normalize=False, sample_format="float32")
    line = F.concat_ws("\t", F.lit("2024-00-00"), F.lpad("rid", 6, "0"), "file", (F.col("rid") / 10).cast("string"))
    logs = a.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("t"))
    text = F.concat(F.lit("date\ttime\tch_s_file\tch_s_delay\n"), "t", F.lit("\n"))
    write_files(logs.select(F.concat("folder", F.lit("/r.log")).alias("file"), text.cast("binary").alias("content")), where)
    ds = folders.load(spark, where, duration=True)
    return ds.channels.select("record_id", "channel", "file", "file_id", "delay").join(ds.files.select("file_id", "duration"), "file_id").select("record_id", "channel", "file", "file_id", "duration", "delay")


@query("scan_columns", "select record_id, rig from record_db where rig is not null and record_id is not null")
def _(spark, d):
    return table(spark, d, "record_db").where("rig is not null and record_id is not null").select("record_id", "rig")
