"""Schemas that drift from file to file: one table, and every change.

Each log's fields are inferred as a tagged union: a bit mask of the alternatives (integer, decimal, text) its values
take. Masks of parallel parts fuse with bit_or, so a log of any length is combined map-side. A field's type is the widest
alternative present; values that the canonical conversion cannot take go into the field's text branch. Changes come from
comparing a log's fused schema with the rig's earlier ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import BLANKS, attach_by_key, carry_forward

# Spellings of the fields that have no rule of their own.
ALIASES = {
    "date": "date day datum dia fecha date_rec rec_date log_date jour data",
    "time": "time tm clock hms hora uhrzeit rec_time time_rec heure zeit",
    "temp_c": "temp_c temp tempc temperature t_cage temp_cage cage_temp temperatura",
    "humidity": "humidity hum humedad rh rel_hum humidity_pct feuchte",
    "operator": "operator oper observer user_initials who user initials",
    "trigger": "trigger trig triggered auto_trig trigger_auto",
    "gain": "gain gain_db amp_gain preamp gaindb preamp_gain",
}
# What the last part of a channel's field is called.
CHANNEL_PARTS = {"file": "file wav fname filename name", "min": "min lo low minimum", "max": "max hi high maximum", "delay": "delay dly lag"}
MISSING = ["", "na", "nan", "-"]
INTEGER, DECIMAL, TEXT = 1, 2, 4
QUOTES = "\"'\ufeff"
FILES = {"ch_s_file", "ch_vs_file"}


def _spellings(fields: set[str]) -> dict[str, str]:
    """Every spelling (lower case, blanks and hyphens as _) that names a field, with that field."""
    out = {}
    for proper, spelled in ALIASES.items():
        out |= {s: proper for s in spelled.split() if proper in fields}
    for c in ("s", "vs"):
        for kind, words in CHANNEL_PARTS.items():
            if f"ch_{c}_{kind}" in fields:
                for w in words.split():
                    for s in (f"ch_{c}_{w}", f"ch{c}_{w}", f"{c}_{w}", f"{w}_ch_{c}", f"{w}_ch{c}", f"{w}_{c}", f"ch_{w}_{c}"):
                        out[s] = f"ch_{c}_{kind}"
    return out | {f: f for f in fields}


def field_of(name: str, fields: set[str]) -> str | None:
    """Proper name of a header spelling, None if it names no field."""
    return _spellings(fields).get(re.sub(r"[\s\-]+", "_", name.strip().lower()))


def clean(col: Column) -> Column:
    """A header or value without outer blanks, quotes and byte-order marks."""
    return F.btrim(col, F.lit(BLANKS + QUOTES))


def _separator(header: Column) -> Column:
    """Regular expression of the header's separator: the most frequent of tab, semicolon, bar, comma."""
    n = {p: F.length(header) - F.length(F.replace(header, F.lit(c))) for c, p in (("\t", "\t"), (";", ";"), ("|", "\\|"), (",", ","))}
    top = F.greatest(*n.values())
    out = F.lit("\t")
    for p, c in reversed(n.items()):
        out = F.when((c == top) & (top > 0), F.lit(p)).otherwise(out)
    return out


def headers(lines: DataFrame, fields: list[str]) -> DataFrame:
    """One row per log: rig, log_seq, sep, names (cleaned spellings), proper (field of each position, or NULL), n_lines.

    The header is line 0 of the earliest delivery. If two columns mean one field, the first counts. fields is the
    catalogue of proper names (fixed and small). Logs without a line 0 are not present (see data_lines).
    """
    spell = F.create_map(*[F.lit(x) for kv in _spellings(set(fields)).items() for x in kv])
    logs = lines.groupBy("rig", "log_seq").agg(
        F.min(F.when(F.col("line_no") == 0, F.struct("arrived_at", F.coalesce("line", F.lit("")).alias("line")))).alias("_h"), F.count("*").alias("n_lines")
    )
    logs = logs.where(F.col("_h").isNotNull() & F.col("rig").isNotNull() & F.col("log_seq").isNotNull()).select("rig", "log_seq", "n_lines", F.col("_h.line").alias("header"))
    logs = logs.withColumn("sep", _separator(F.col("header")))
    logs = logs.withColumn("names", F.transform(F.split(F.col("header"), F.col("sep")), clean))
    logs = logs.withColumn("_p", F.transform("names", lambda x: F.try_element_at(spell, F.regexp_replace(F.lower(x), r"[\s\-]+", "_"))))
    proper = F.transform("_p", lambda x, i: F.when(F.array_position("_p", x) == i + 1, x))
    return logs.select("rig", "log_seq", "n_lines", "sep", "names", proper.alias("proper"))


def data_lines(lines: DataFrame, logs: DataFrame, n_rows: int, headless: bool = False) -> DataFrame:
    """Data lines with their log's header attached: ..., sep, names, proper, vals (cleaned). Repeated headers fall out.

    headless also keeps the lines that have no header (their log has no line 0, or they name no log): with names and
    proper NULL and the whole line as the one value.
    """
    body = lines.where((F.col("line_no") > 0) | F.col("line_no").isNull() if headless else F.col("line_no") > 0)
    j = attach_by_key(body, logs, ["rig", "log_seq"], "n_lines", n_rows, F.col("line_no"), "left" if headless else "inner")
    j = j.withColumn("vals", F.transform(F.when(F.col("sep").isNull(), F.array(F.coalesce("line", F.lit("")))).otherwise(F.split(F.coalesce("line", F.lit("")), F.col("sep"))), clean))
    same = F.lower(F.array_join("vals", "\t")) == F.lower(F.array_join("names", "\t"))
    return j.where(F.coalesce(~same, F.lit(True)))


def alternative(value: Column) -> Column:
    """Tag of one value: INTEGER, DECIMAL or TEXT; NULL if it is missing."""
    return (
        F.when(value.isNull() | F.lower(value).isin(*MISSING), None)
        .when(value.rlike(r"^[+-]?\d+$"), INTEGER)
        .when(value.rlike(r"^[+-]?(\d+[.,]\d*|[.,]\d+)$"), DECIMAL)
        .otherwise(TEXT)
    )


def fused_schemas(data: DataFrame) -> DataFrame:
    """rig, log_seq, field, mask: the alternatives of each field with any value, fused over the log's lines."""
    tags = F.transform("proper", lambda f, i: F.struct(f.alias("field"), alternative(F.get("vals", i)).alias("tag")))
    cells = data.select("rig", "log_seq", F.explode(F.filter(tags, lambda t: t["field"].isNotNull() & t["tag"].isNotNull())).alias("c"))
    return cells.groupBy("rig", "log_seq", F.col("c.field").alias("field")).agg(F.bit_or("c.tag").alias("mask"))


def type_of(mask: Column) -> Column:
    return F.when(mask.bitwiseAND(F.lit(TEXT)) > 0, "text").when(mask.bitwiseAND(F.lit(DECIMAL)) > 0, "decimal").when(mask > 0, "integer")


def schema_changes(lines: DataFrame, fields: list[str], n_rows: int) -> DataFrame:
    """Changes from log to log of a rig: rig, log_seq, field, change_kind, before, after.

    'added', 'removed', 'renamed' compare with the rig's log of the next smaller log_seq present; 'retyped' compares the
    fused type with that of the rig's last earlier log with any value in the field. The rig's first log has none. Logs
    delivered twice, empty lines and logs without data change nothing; an empty input gives no row.
    """
    logs = headers(lines, fields)
    named = F.map_from_entries(
        F.filter(F.transform("proper", lambda f, i: F.struct(f.alias("field"), F.get("names", i).alias("name"))), lambda s: s["field"].isNotNull())
    )
    spelled = logs.select("rig", "log_seq", F.to_json(named).alias("now"))
    pairs = carry_forward(spelled, ["rig"], "log_seq", "now", "was").where(F.col("was").isNotNull())
    kind = "map<string,string>"
    pairs = pairs.select("rig", "log_seq", F.from_json("now", kind).alias("now"), F.from_json("was", kind).alias("was"))
    each = pairs.select("rig", "log_seq", "now", "was", F.explode(F.array_union(F.map_keys("now"), F.map_keys("was"))).alias("field"))
    each = each.select("rig", "log_seq", "field", F.try_element_at("was", F.col("field")).alias("before"), F.try_element_at("now", F.col("field")).alias("after"))
    shape = each.withColumn(
        "change_kind", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "renamed")
    ).where(F.col("change_kind").isNotNull())
    types = fused_schemas(data_lines(lines, logs, n_rows)).withColumn("after", type_of(F.col("mask")))
    types = carry_forward(types, ["rig", "field"], "log_seq", "after", "before")
    retyped = types.where(F.col("before") != F.col("after")).withColumn("change_kind", F.lit("retyped"))
    cols = ["rig", "log_seq", "field", "change_kind", "before", "after"]
    return shape.select(*cols).unionByName(retyped.select(*cols))


def canonical_date(v: Column) -> Column:
    """A day in any of the spellings met: ISO, compact, dotted and slashed (day first unless the year leads), named month."""
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd")),
        F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd")),
        F.when(v.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(v, "d.M.yyyy")),
        F.when(v.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.try_to_date(v, "yyyy/M/d")),
        F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(v, "d/M/yyyy")),
        F.when(v.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}$"), F.try_to_date(v, "d MMM yyyy")),
    )


def canonical_time(v: Column) -> Column:
    """A time of day as HH:mm:ss: separated by colons, dots or h-m-s, six digits, or (decimal) seconds of the day."""
    parts = F.regexp_replace(v, r"^(\d{1,2})[:.h](\d{2})[:.m](\d{2})s?$", "$1:$2:$3")
    seconds = F.floor(F.regexp_replace(v, ",", ".").try_cast("double") + 0.5).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
    return (
        F.when(v.rlike(r"^\d{1,2}[:.h]\d{2}[:.m]\d{2}s?$"), F.lpad(parts, 8, "0"))
        .when(v.rlike(r"^\d{6}$"), F.concat_ws(":", F.substring(v, 1, 2), F.substring(v, 3, 2), F.substring(v, 5, 2)))
        .when(v.rlike(r"^\d{1,5}[.,]\d*$"), clock)
    )


def canonical_number(v: Column) -> Column:
    """A number with decimal point or comma, its unit (letters, % or degree sign) dropped."""
    return F.regexp_replace(F.regexp_replace(v, r"\s*[A-Za-z%°]+$", ""), ",", ".").try_cast("double")


def appearing_alternatives(lines: DataFrame, fields: list[str], n_rows: int) -> DataFrame:
    """rig, log_seq, field, alternative: where a field's values first take a form that none of the rig's earlier logs had.

    The first log of a rig with any value in a field begins its union and reports nothing.
    """
    masks = fused_schemas(data_lines(lines, headers(lines, fields), n_rows))
    tags = F.array(*[F.struct(F.lit(t).alias("tag"), F.lit(n).alias("alternative")) for t, n in ((INTEGER, "integer"), (DECIMAL, "decimal"), (TEXT, "text"))])
    each = masks.select("rig", "log_seq", "field", "mask", F.explode(tags).alias("t")).where(F.col("mask").bitwiseAND(F.col("t.tag")) > 0)
    first = each.groupBy("rig", "field", F.col("t.alternative").alias("alternative")).agg(F.min("log_seq").alias("log_seq"))
    begin = F.min("log_seq").over(W.partitionBy("rig", "field"))  # over the alternatives of a field: three rows at most
    return first.withColumn("_begin", begin).where(F.col("log_seq") > F.col("_begin")).select("rig", "log_seq", "field", "alternative")


def canonical_table(lines: DataFrame, fields: list[str], n_rows: int) -> DataFrame:
    """One row per data line (rig, log_seq, line_no, once): each field with one name and type, and its text branch.

    date is DATE, time HH:mm:ss, files and operator text, the rest double; <field>_text holds the value as written where
    the conversion does not take it or it carries a unit, else NULL. unknown_text (JSON, name and value) holds what no
    field takes: columns that the catalogue lacks, second columns of a field, values beyond the header, and whole lines
    of logs without a header. Missing values are NULL. Of a line delivered twice the earliest delivery counts, as with
    headers. Lines without any value are dropped.
    """
    data = data_lines(lines, headers(lines, fields), n_rows, headless=True)
    given = lambda x: alternative(x).isNotNull()
    cells = F.transform("vals", lambda x, i: F.struct(F.get("proper", i).alias("k"), F.coalesce(F.get("names", i), F.when(F.col("names").isNull(), F.lit("line")), F.concat(F.lit("column "), (i + 1).cast("string"))).alias("name"), x.alias("value")))
    some = F.filter(cells, lambda c: given(c["value"]))
    at = F.map_from_entries(F.transform(F.filter(some, lambda c: c["k"].isNotNull()), lambda c: F.struct(c["k"], c["value"])))
    rest = F.filter(some, lambda c: c["k"].isNull())
    unknown = F.when(F.size(rest) > 0, F.to_json(F.transform(rest, lambda c: F.struct(c["name"], c["value"]))))
    whose = F.when(F.col("rig").isNull() | F.col("log_seq").isNull() | F.col("line_no").isNull(), F.col("line"))  # lines that name no place are kept apart
    data = data.select("rig", "log_seq", "line_no", "arrived_at", whose.alias("_whose"), at.alias("m"), unknown.alias("unknown_text")).where((F.size("m") > 0) | F.col("unknown_text").isNotNull())
    cols = []
    for f in fields:
        v = F.try_element_at("m", F.lit(f))
        if f in FILES or f == "operator":
            cols.append(v.alias(f))
            continue
        typed = canonical_date(v) if f == "date" else canonical_time(v) if f == "time" else canonical_number(v)
        plain = typed.isNotNull() & ((alternative(v) != TEXT) if f not in ("date", "time") else F.lit(True))
        cols += [typed.alias(f), F.when(~plain, v).alias(f"{f}_text")]
    key = ["rig", "log_seq", "line_no", "_whose"]
    flat = data.select(*key, "arrived_at", *cols, "unknown_text")
    rest = [c for c in flat.columns if c not in (*key, "arrived_at")]
    return flat.groupBy(*key).agg(F.min(F.struct("arrived_at", *rest)).alias("_v")).select("rig", "log_seq", "line_no", *[F.col(f"_v.{c}").alias(c) for c in rest])
