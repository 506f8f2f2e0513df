"""Interval generators and interval algebra on annotation tables.

An annotation table has record_id, annot_id, start, end (seconds); touching intervals do not overlap. Every operator keys
its joins by record_id and bounds them by the interval itself; none pairs all rows of a record.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import attach_by_key, carry_forward, shipped
from .ordered import CHUNK, number_rows
from .signals import all_of

SLOT_S = 64.0


def segment_islands(samples: DataFrame, lower: float, upper: float, rate: float = 1.0, delay: float = 0.0, key: str = "rid") -> DataFrame:
    """Detection by hysteresis: runs of values >= lower whose maximum is > upper.

    samples: key, i (0-based), v. Result: key, annot_id (by start), start, end, max_env; start is the left edge of the
    last sample below, end the right edge of the last one above. NULL and NaN values count as below. No run, no row.
    """
    v = F.nanvl(F.col("v").cast("double"), F.lit(None).cast("double"))
    # runs inside chunks first: one shuffle of the samples, which are then down to pieces of runs
    cut = samples.select(key, "i", v.alias("v"), F.floor(F.col("i") / CHUNK).alias("_chunk"))
    inner = W.partitionBy(key, "_chunk").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    above = F.coalesce(F.col("v") >= lower, F.lit(False))
    pieces = (
        cut.withColumn("_g", F.sum(F.when(above, 0).otherwise(1)).over(inner)).where(above).groupBy(key, "_chunk", "_g").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.max("v").alias("max_env"))
    )
    # only pieces at a chunk's border can go on in another one: a window along the record over these alone
    border = (F.col("i0") % CHUNK == 0) | (F.col("i1") % CHUNK == CHUNK - 1)
    along = W.partitionBy(key, "_own").orderBy("i0")
    joined = pieces.withColumn("_own", F.when(~border, F.col("i0"))).withColumn("_new", F.coalesce(F.col("i0") > F.lag("i1").over(along) + 1, F.lit(True)).cast("int"))
    runs = (
        joined.withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(key, "_own", "_run")
        .agg(F.min("i0").alias("i0"), F.max("i1").alias("i1"), F.max("max_env").alias("max_env"))
        .where(F.col("max_env") > upper)
    )
    start = F.bround(F.greatest(F.col("i0") - 1, F.lit(0)).cast("double") / rate + delay, 3)
    end = F.bround((F.col("i1") + 1).cast("double") / rate + delay, 3)
    return number_rows(runs, [key], ["i0"], "annot_id", F.floor(F.col("i0") / CHUNK)).select(key, "annot_id", start.alias("start"), end.alias("end"), "max_env")


def detect_all(signals: DataFrame, key: str = "rid", rate: float = 1.0, delay: float = 0.0) -> DataFrame:
    """One interval over each whole signal; signals: key and n (number of samples)."""
    return signals.select(key, F.lit(0).cast("bigint").alias("annot_id"), F.lit(float(delay)).alias("start"), (F.col("n") / rate + delay).alias("end"))


def renumber(annots: DataFrame, key: str = "rid", extra_order: Sequence[str] = ()) -> DataFrame:
    """annot_id anew: 0-based per record by start, then end."""
    rest = annots.drop("annot_id")
    return number_rows(rest, [key], ["start", "end", *extra_order], "annot_id", F.floor(F.col("start") / SLOT_S))


def register(annots: DataFrame, records: DataFrame, key: str = "record_id") -> DataFrame:
    """Annotation table in canonical form: rows without annot_id dropped, datetime, duration and comment filled in.

    records: key, datetime (one row each). Extra columns stay behind the fixed ones. Raises nothing on duplicates: see
    duplicate_annotations.
    """
    extra = [c for c in annots.columns if c not in (key, "annot_id", "start", "end", "duration", "datetime", "comment")]
    a = annots.where(F.col("annot_id").isNotNull())
    comment = F.coalesce(a["comment"].cast("string"), F.lit("")) if "comment" in annots.columns else F.lit("")
    a = a.select(key, "annot_id", "start", "end", comment.alias("comment"), *extra)
    w = a.groupBy(key).agg(F.count("*").alias("_w"))
    at = records.select(key, F.col("datetime").alias("_at")).join(w, key)
    j = attach_by_key(a, at, [key], "_w", all_of(w, "_w"), F.col("annot_id"), "left")
    at = F.expr("_at + make_dt_interval(0, 0, 0, cast(start as decimal(18,6)))")
    return j.select(key, "annot_id", "start", "end", (F.col("end") - F.col("start")).alias("duration"), at.alias("datetime"), "comment", *extra)


def duplicate_annotations(annots: DataFrame, key: str = "record_id") -> DataFrame:
    """Keys that occur more than once: the uniqueness check of register as a relation."""
    return annots.groupBy(key, "annot_id").agg(F.count("*").alias("n")).where("n > 1")


def _overlapping(x: DataFrame, y: DataFrame, key: str, how: str, slot: float = SLOT_S) -> DataFrame:
    """x joined with the y that overlap it, by (key, time slot): no record's rows meet in one task.

    x has _s, _e, _xid; y has _ys, _ye. Each pair comes once: in the slot where the later of the two starts.
    """
    cut = lambda s, e: F.explode(F.sequence(F.floor(s / slot), F.floor(F.greatest(s, e) / slot)))
    xs = x.withColumn("_slot", cut(F.col("_s"), F.col("_e")))
    ys = y.withColumn("_slot", cut(F.col("_ys"), F.col("_ye")))
    on = [xs[key] == ys[key], xs["_slot"] == ys["_slot"], xs["_s"] < ys["_ye"], xs["_e"] > ys["_ys"], xs["_slot"] == F.floor(F.greatest(xs["_s"], ys["_ys"]) / slot)]
    return xs.join(ys, on, how).drop(ys[key]).drop(ys["_slot"])


def intersect(x: DataFrame, y: DataFrame, key: str = "rid", x_name: str = "x", y_name: str = "y", x_cols: Sequence[str] = (), y_cols: Sequence[str] = ()) -> DataFrame:
    """All pairs of overlapping intervals as their common part, with both sources' ids (and chosen columns, prefixed).

    Nested and overlapping inputs give every pair. NULL bounds overlap nothing; touching intervals neither.
    """
    xa = x.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("annot_id").alias(f"{x_name}_annot_id"), *[F.col(c).alias(f"{x_name}_{c}") for c in x_cols])
    ya = y.select(key, F.col("start").alias("_ys"), F.col("end").alias("_ye"), F.col("annot_id").alias(f"{y_name}_annot_id"), *[F.col(c).alias(f"{y_name}_{c}") for c in y_cols])
    j = _overlapping(xa, ya, key, "inner")
    rows = j.select(key, F.greatest("_s", "_ys").alias("start"), F.least("_e", "_ye").alias("end"), *[c for c in j.columns if c not in (key, "_s", "_e", "_ys", "_ye", "_slot")])
    return renumber(rows, key, (f"{x_name}_annot_id", f"{y_name}_annot_id"))


def difference(x: DataFrame, y: DataFrame, key: str = "rid", x_name: str = "x") -> DataFrame:
    """x without what any y covers: an interval may vanish, shrink or fall into pieces.

    Overlapping and nested y are allowed. Windows run per interval of x over the y that touch it. Result: key, annot_id
    (renumbered), start, end, <x_name>_annot_id.
    """
    xid = f"{x_name}_annot_id"
    xa = x.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("annot_id").alias(xid))
    ya = y.select(key, F.col("start").alias("_ys"), F.col("end").alias("_ye"))
    hits = _overlapping(xa, ya, key, "inner").select(key, xid, "_s", "_e", "_ys", "_ye")
    marks = hits.unionByName(xa.select(key, xid, "_s", "_e", F.col("_e").alias("_ys"), F.col("_e").alias("_ye")))
    w = W.partitionBy(key, xid).orderBy("_ys", "_ye").rowsBetween(W.unboundedPreceding, -1)
    begin = F.greatest(F.col("_s"), F.coalesce(F.max("_ye").over(w), F.col("_s")))
    cut = marks.select(key, xid, begin.alias("start"), F.least("_ys", "_e").alias("end")).where(F.col("start") < F.col("end"))
    return renumber(cut, key, (xid,)).select(key, "annot_id", "start", "end", xid)


def overlap_filter(annots: DataFrame, windows: DataFrame, key: str = "rid") -> DataFrame:
    """Annotations (unique by key and annot_id) that overlap a window of their record, each once; windows: key, start, end."""
    x = annots.select(key, "annot_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    y = windows.select(key, F.col("start").alias("_ys"), F.col("end").alias("_ye"))
    hits = _overlapping(x, y, key, "inner").select(key, "annot_id").distinct()
    return annots.join(hits, [key, "annot_id"], "left_semi")


def flanking(annots: DataFrame, before: float, after: float) -> DataFrame:
    """Intervals extended on both sides."""
    return annots.withColumn("start", F.col("start") - before).withColumn("end", F.col("end") + after)


def consolidate(annots: DataFrame, when: str | Callable[[dict], bool], additive: Sequence[str] = (), key: str = "rid", drop_singletons: bool = False, max_gap: float | None = None) -> DataFrame:
    """Runs of neighbours (by start, end, annot_id) merged while the predicate holds for the row that would result.

    when, a query string (see functions.query.row_predicate) or a function of the row as a dict, may use start, end, duration, consolidated_duration (sum of the parts), n and
    the additive columns of the merged row. Merged: start and annot_id of the first, end of the last, comments joined,
    additive columns summed. drop_singletons leaves out records of one annotation. The fold is sequential by definition:
    rows are sorted by record and start (a sort that spills) and stream through with one open run as the only state, so
    no record is ever held as a whole. max_gap says that no run goes on over a longer gap between neighbours: records are
    then cut there and their parts folded in parallel. Rows with NULL start or end are left out.
    """
    add = list(additive)
    fields = ["annot_id", "start", "end", *add, "comment"]
    import pyarrow as pa

    comment = F.coalesce(F.col("comment").cast("string"), F.lit("")) if "comment" in annots.columns else F.lit("")
    rows = annots.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(
        F.col(key).cast("bigint").alias(key), F.col("annot_id").cast("bigint").alias("annot_id"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in add], comment.alias("comment")
    )
    out_names = [key, "annot_id", "start", "end", "duration", "consolidated_duration", "n", *add, "comment"]
    out_types = ["bigint", "bigint", "double", "double", "double", "double", "bigint", *["double"] * len(add), "string"]
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(n, arrow[x]) for n, x in zip(out_names, out_types, strict=True)])

    def fold(batches):
        from sigweave.functions.query import row_predicate

        holds = when if callable(when) else row_predicate(when)
        run, record, place, parts, out = None, None, None, 0, [[] for _ in out_names]

        def emit():
            if run is not None and not (drop_singletons and parts == 1):
                for c, n in zip(out, out_names, strict=True):
                    c.append(record if n == key else run[n])

        for b in batches:
            cols = [b.column(c).to_pylist() for c in (key, "_part", *fields)]
            for rid, part, *vals in zip(*cols, strict=True):
                r = dict(zip(fields, vals, strict=True))
                length = r["end"] - r["start"]
                if run is not None and (rid, part) == (record, place):
                    parts += 1
                    m = run | {"end": r["end"], "duration": r["end"] - run["start"], "consolidated_duration": run["consolidated_duration"] + length, "n": run["n"] + 1, "comment": run["comment"] + r["comment"]} | {c: run[c] + r[c] for c in add}
                    if holds(m):
                        run = m
                        continue
                    emit()
                else:
                    emit()
                    record, place, parts = rid, part, 1
                run = r | {"duration": length, "consolidated_duration": length, "n": 1}
            if len(out[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = [[] for _ in out_names]
        emit()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    if max_gap is not None and drop_singletons:
        single = rows.groupBy(key).agg(F.count("*").alias("_w")).where("_w = 1")
        rows, drop_singletons = rows.join(single.select(key), key, "left_anti"), False
    if max_gap is None:
        rows = rows.withColumn("_part", F.lit(0).cast("bigint"))
    else:
        placed = number_rows(rows, [key], ["start", "end", "annot_id"], "_at", F.floor(F.col("start") / SLOT_S))
        placed = carry_forward(placed, [key], "_at", "end", "_before", CHUNK)
        placed = placed.withColumn("_head", F.when(F.col("_before").isNull() | (F.col("start") - F.col("_before") > max_gap), F.col("_at")))
        rows = carry_forward(placed, [key], "_at", "_head", "_earlier", CHUNK).withColumn("_part", F.coalesce("_head", "_earlier")).drop("_at", "_before", "_head", "_earlier")
    ordered = shipped(rows).repartition(key, "_part").sortWithinPartitions(key, "_part", "start", "end", "annot_id")
    return ordered.mapInArrow(fold, ", ".join(f"`{n}` {x}" for n, x in zip(out_names, out_types, strict=True)))


def remaining_records(records: DataFrame, annots: DataFrame, key: str = "record_id") -> DataFrame:
    """Records without any annotation row: the work still to do."""
    return records.join(annots.select(key), key, "left_anti")


def high_water(source: DataFrame, target: DataFrame, key: str = "record_id") -> DataFrame:
    """Incremental selection: rows of source beyond the greatest key in target (all, if target is empty)."""
    top = target.select(F.max(key)).scalar()
    return source.where(F.coalesce(F.col(key) > top, F.lit(True)))
