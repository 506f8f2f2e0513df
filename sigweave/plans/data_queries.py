"""Queries of the general data problems (p1 to p5) with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, compaction, drift, orphans, periods
from ..operators.common import blank_trim, current_rows, shared_dir, to_ms

NO_ANNOT = -1


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What the next run must handle, by a tracker of each table: its state is what the successful runs left."""
    runs, where = table(spark, d, "run_log"), shared_dir(spark, "changes")

    def due(name: str, keys: list[str], done: str, content: list[Column], current: DataFrame) -> DataFrame:
        tracker = changes.ChangeTracker(spark, f"{where}/{name}", keys)
        tracker.seed(changes.state_from_history(table(spark, d, done), runs, keys, content))
        return tracker.plan_hashed(current).due.select(F.lit(name).alias("table_name"), *keys)

    key, content = ["record_id"], [F.col("ch_s_file"), F.col("ch_vs_file")]
    rec = current_rows(table(spark, d, "record_db"), key, {changes.HASH: changes.content_hash(*content), "gone": F.col("deleted_at").isNotNull()}).where(~F.col("gone"))
    rec_due = due("record_db", key, "record_done", content, rec)
    key = ["record_id", "annot_id"]
    content = [to_ms(F.col("start")), to_ms(F.col("end")), F.coalesce(blank_trim(F.col("comment")), F.lit(""))]
    ann = current_rows(table(spark, d, "annot_db"), key, {changes.HASH: changes.content_hash(*content)})
    return rec_due.withColumn("annot_id", F.lit(NO_ANNOT).cast("bigint")).unionByName(due("annot_db", key, "annot_done", content, ann))


P1_SQL = """
with ok as (select run_id from run_log where status = 'ok'),
rec as (select record_id, ch_s_file a, ch_vs_file b, deleted_at from record_db where record_id is not null
  qualify row_number() over (partition by record_id order by updated_at desc nulls last, loaded_at desc nulls last) = 1),
rec_done as (select record_id, ch_s_file a, ch_vs_file b from record_done where run_id in (select run_id from ok)
  qualify row_number() over (partition by record_id order by run_id desc) = 1),
ann as (select record_id, annot_id, round(start * 1000)::bigint a, round("end" * 1000)::bigint b, coalesce(trim(comment), '') c from annot_db
  where record_id is not null and annot_id is not null
  qualify row_number() over (partition by record_id, annot_id order by updated_at desc nulls last, loaded_at desc nulls last) = 1),
ann_done as (select record_id, annot_id, round(start * 1000)::bigint a, round("end" * 1000)::bigint b, coalesce(trim(comment), '') c from annot_done
  where run_id in (select run_id from ok) qualify row_number() over (partition by record_id, annot_id order by run_id desc) = 1)
select 'record_db' table_name, r.record_id, -1::bigint annot_id from rec r left join rec_done d on r.record_id = d.record_id
where r.deleted_at is null and (d.record_id is null or r.a is distinct from d.a or r.b is distinct from d.b)
union all
select 'annot_db', r.record_id, r.annot_id from ann r left join ann_done d on r.record_id = d.record_id and r.annot_id = d.annot_id
where d.record_id is null or r.a is distinct from d.a or r.b is distinct from d.b or r.c <> d.c
"""


def _compacted(spark: SparkSession, d: str) -> compaction.CatalogueCompaction:
    """Every level of the compaction of file_db's pieces, journalled in the shared folder."""
    return compaction.CatalogueCompaction(spark, shared_dir(spark, "compaction")).run(compaction.whole_pieces(table(spark, d, "file_db")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The inputs that the journal has of the first level, which merges files of the lowest tier."""
    return _compacted(spark, d).merges(1).select("record_id", F.col("file_id").cast("bigint").alias("file_id"))


P2_SQL = """
with whole as (select record_id, lower(trim(channel)) ch, piece_no, file_id, written_at, n_bytes from file_db
  where record_id is not null and channel is not null and n_bytes = 44 + n_samples * case sample_fmt when 'int16' then 2 when 'float32' then 4 end),
kept as (select * from whole qualify row_number() over (partition by record_id, ch, piece_no order by written_at nulls last, file_id) = 1)
select record_id, file_id from kept where n_bytes < 65536 qualify count(*) over (partition by record_id, ch) >= 4
"""


def p2_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The files that the merges of every level write."""
    return _compacted(spark, d).files().where("level > 0").select("record_id", "channel", "level", "n_inputs", F.col("n_bytes").alias("out_bytes"), "first_piece", "last_piece")


def _levels_sql() -> str:
    tier = " + ".join(f"(n_bytes >= {compaction.BASE_BYTES * 4**k})::int" for k in range(10))
    out = f"""
with whole as (select record_id, lower(trim(channel)) channel, piece_no, file_id, written_at, n_bytes from file_db
  where record_id is not null and channel is not null and n_bytes = 44 + n_samples * case sample_fmt when 'int16' then 2 when 'float32' then 4 end),
f0 as (select record_id, channel, piece_no a, piece_no z, n_bytes, 1::bigint n_inputs, {tier} tier from whole
  qualify row_number() over (partition by record_id, channel, piece_no order by written_at nulls last, file_id) = 1)"""
    for t in range(6):
        live = " union all ".join(f"select * from f{k} where tier = {t}" for k in range(t + 1))
        out += f""",
l{t} as (select *, count(*) over g c, sum(n_bytes) over g tot, coalesce(sum(n_bytes) over (partition by record_id, channel order by a rows between unbounded preceding and 1 preceding), 0) b from ({live}) window g as (partition by record_id, channel)),
f{t + 1} as (select *, {tier} tier from (select record_id, channel, min(a) a, max(z) z, (sum(n_bytes - 44) + 44)::bigint n_bytes, count(*) n_inputs from l{t} where c >= 4
  group by record_id, channel, floor((b + n_bytes / 2.0::double) * greatest(ceil(tot / 33554432.0::double), 1) / tot) having count(*) > 1))"""
    return out + " union all ".join(f" select record_id, channel, {t}::int \"level\", n_inputs, n_bytes out_bytes, a first_piece, z last_piece from f{t}" for t in range(1, 7))


P2_OUTPUTS_SQL = _levels_sql()


def _log_fields(spark: SparkSession, d: str) -> list[str]:
    """The catalogue of fields: a fixed table of 13 rows."""
    return sorted(r.field for r in table(spark, d, "log_field").where(F.col("field").isNotNull()).distinct().collect())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "avimat_log")
    return drift.schema_changes(lines, _log_fields(spark, d), lines.count()).select("rig", "log_seq", "field", "change_kind")


def _fields_sql() -> str:
    """The field a spelling s names, as rules of the SQL's own."""
    words = {
        "date": "date|day|datum|dia|fecha|jour|data|date_rec|rec_date|log_date", "time": "time|tm|clock|hms|hora|uhrzeit|heure|zeit|rec_time|time_rec",
        "temp_c": "temp|temp_c|tempc|temperature|temperatura|t_cage|temp_cage|cage_temp", "humidity": "hum|humidity|humidity_pct|humedad|rh|rel_hum|feuchte",
        "operator": "oper|operator|observer|user|initials|user_initials|who", "trigger": "trig|trigger|triggered|auto_trig|trigger_auto", "gain": "gain|gain_db|gaindb|amp_gain|preamp|preamp_gain",
    }
    for c in ("s", "vs"):
        for kind, w in (("file", "file|filename|fname|name|wav"), ("min", "min|minimum|lo|low"), ("max", "max|maximum|hi|high"), ("delay", "delay|dly|lag")):
            words[f"ch_{c}_{kind}"] = f"(ch_?)?{c}_({w})|({w})_(ch_?)?{c}|ch_({w})_{c}"
    return "case " + " ".join(f"when s = '{f}' or regexp_full_match(s, '{w}') then '{f}'" for f, w in words.items()) + " else s end"


_P3 = f"""
with q as (select ' ' || chr(9) || chr(10) || chr(12) || chr(13) || chr(160) || '"' || chr(39) || chr(65279) t),
hd as (select rig, log_seq, coalesce(line, '') line from avimat_log where line_no = 0 qualify row_number() over (partition by rig, log_seq order by arrived_at, line) = 1),
hn as (select *, len(line) - len(replace(line, chr(9), '')) n1, len(line) - len(replace(line, ';', '')) n2, len(line) - len(replace(line, '|', '')) n3, len(line) - len(replace(line, ',', '')) n4 from hd),
hs as (select rig, log_seq, line, case greatest(n1, n2, n3, n4) when n1 then chr(9) when n2 then ';' when n3 then '|' else ',' end sep from hn),
hv as (select rig, log_seq, sep, list_transform(string_split(line, sep), lambda x: trim(x, t)) names from hs, q),
nm as (select rig, log_seq, unnest(names) name, generate_subscripts(names, 1) pos from hv),
ns as (select *, regexp_replace(lower(name), '[\\s-]+', '_', 'g') s from nm),
nf as (select *, {_fields_sql()} f from ns),
ff as (select rig, log_seq, pos, name, f from nf where f in (select field from log_field)
  qualify row_number() over (partition by rig, log_seq, f order by pos) = 1),
sq as (select rig, log_seq, lag(log_seq) over (partition by rig order by log_seq) p from hd),
shape as (select sq.rig, sq.log_seq, n.f field, case when o.name is null then 'added' when o.name <> n.name then 'renamed' end change_kind
  from sq join ff n on n.rig = sq.rig and n.log_seq = sq.log_seq left join ff o on o.rig = sq.rig and o.log_seq = sq.p and o.f = n.f where p is not null
  union all select sq.rig, sq.log_seq, o.f, 'removed' from sq join ff o on o.rig = sq.rig and o.log_seq = sq.p left join ff n on n.rig = sq.rig and n.log_seq = sq.log_seq and n.f = o.f where n.f is null),
ln as (select distinct rig, log_seq, line_no, coalesce(line, '') line from avimat_log where line_no > 0),
lv as (select rig, log_seq, line_no, names, list_transform(string_split(line, sep), lambda x: trim(x, t)) vals from ln join hv using (rig, log_seq), q),
cv as (select rig, log_seq, f field, vals[pos] v from lv join ff using (rig, log_seq)
  where list_transform(vals, lambda x: lower(x)) <> list_transform(names, lambda x: lower(x)) and pos <= len(vals) and lower(vals[pos]) not in ('', 'na', 'nan', '-')),
tg as (select rig, log_seq, field, case when regexp_full_match(v, '[+-]?\\d+') then 1 when regexp_full_match(v, '[+-]?(\\d+[.,]\\d*|[.,]\\d+)') then 2 else 4 end tag from cv),
ty as (select rig, log_seq, field, bit_or(tag) alternatives, case max(tag) when 1 then 'integer' when 2 then 'decimal' else 'text' end ty from tg group by all),
rt as (select *, lag(ty) over (partition by rig, field order by log_seq) was from ty)
"""
P3_SQL = _P3 + "select * from shape where change_kind is not null union all select rig, log_seq, field, 'retyped' from rt where was <> ty"
P3_ALTERNATIVES_SQL = _P3 + 'select field, ty "type", alternatives, count(*) n_logs from ty group by all'

P3_APPEARING_SQL = _P3 + """, fa as (select rig, field, tag, min(log_seq) log_seq from tg group by all)
select rig, log_seq, field, case tag when 1 then 'integer' when 2 then 'decimal' else 'text' end alternative from fa qualify log_seq > min(log_seq) over (partition by rig, field)"""


def p3_appearing(spark: SparkSession, d: str) -> DataFrame:
    """Where a field's values first take a form that the rig's earlier logs did not have."""
    lines = table(spark, d, "avimat_log")
    return drift.appearing_alternatives(lines, _log_fields(spark, d), lines.count())


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "avimat_log")
    return drift.canonical_table(lines, _log_fields(spark, d), lines.count())


def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """How many logs have each set of alternatives of a field: what the text branches are for."""
    lines = table(spark, d, "avimat_log")
    data = drift.data_lines(lines, drift.headers(lines, _log_fields(spark, d)), lines.count())
    m = drift.fused_schemas(data)
    return m.groupBy("field", drift.type_of(F.col("mask")).alias("type"), F.col("mask").alias("alternatives")).agg(F.count("*").alias("n_logs"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rec, ann, files = (table(spark, d, t) for t in ("record_db", "annot_db", "file_db"))
    parents = current_rows(rec, ["record_id"], {"deleted": F.col("deleted_at").isNotNull()})
    children = orphans.child_rows(ann, "annot_db", "record_id", "annot_id").unionByName(orphans.child_rows(files, "file_db", "record_id", "file_id"))
    return orphans.orphan_rows(parents, children, ann.count() + files.count())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


_P4 = """
with cur as (select record_id, deleted_at is not null deleted, min(loaded_at) over (partition by record_id) pf from record_db
  qualify row_number() over (partition by record_id order by updated_at desc nulls last, loaded_at desc nulls last) = 1),
child as (select 'annot_db' table_name, record_id, annot_id row_id, min(loaded_at) cf from annot_db where record_id is not null and annot_id is not null group by all
  union all select 'file_db', record_id, file_id, min(loaded_at) from file_db where record_id is not null group by all),
found as (select table_name, c.record_id, row_id, case when r.record_id is null then 'missing' when deleted then 'deleted' when pf > cf then 'late' end reason, strftime(cf, '%Y-%m') period
  from child c left join cur r on c.record_id = r.record_id)
"""
P4_SQL = _P4 + "select * from found where reason is not null"
P4_REPORT_SQL = _P4 + "select table_name, period, reason, count(*) n_rows, count(distinct record_id) n_keys from found where reason is not null group by all"


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    cur = current_rows(table(spark, d, "annot_db"), ["record_id", "annot_id"], {"s": to_ms(F.col("start")), "e": to_ms(F.col("end"))})
    return cur.where((F.col("record_id") > 0) & F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("e") > F.col("s")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return periods.periods_and_gaps(_intervals(spark, d))


P5_SQL = """
with cur as (select record_id, annot_id, round(start * 1000)::bigint s, round("end" * 1000)::bigint e from annot_db where record_id > 0 and annot_id is not null
  qualify row_number() over (partition by record_id, annot_id order by updated_at desc nulls last, loaded_at desc nulls last) = 1),
reach as (select record_id, s, e, max(e) over (partition by record_id order by s, e rows between unbounded preceding and 1 preceding) m from cur where e > s),
mark as (select *, sum(case when m is null or s > m then 1 else 0 end) over (partition by record_id order by s, e rows unbounded preceding) g from reach),
per as (select record_id, g, min(s) s, max(e) e, count(*) n from mark group by all),
gap as (select record_id, lag(e) over (partition by record_id order by g) s, s e from per)
select record_id, 'merged' kind, s start_ms, e end_ms from per where n > 1
union all select record_id, 'gap', s, e from gap where s is not null and e - s <= 3600000
"""

QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_outputs": p2_outputs, "p3_found": p3_found, "p3_table": p3_table, "p3_alternatives": p3_alternatives, "p3_appearing": p3_appearing, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p2_outputs": P2_OUTPUTS_SQL, "p3_found": P3_SQL, "p3_alternatives": P3_ALTERNATIVES_SQL, "p3_appearing": P3_APPEARING_SQL, "p4_found": P4_SQL, "p4_report": P4_REPORT_SQL, "p5_found": P5_SQL}
