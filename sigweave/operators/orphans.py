"""References to records that are missing, deleted or late.

Tagged parent and child keys are united in long form and grouped by key; what lacks a parent, has a deleted one or one
younger than a child is kept, and only those keys meet the child rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_by_key


def child_rows(df: DataFrame, table: str, key: str, row: str, loaded: str = "loaded_at") -> DataFrame:
    """(table_name, record_id, row_id, first_loaded): each referring row once, with its first delivery."""
    return (
        df.where(F.col(key).isNotNull() & F.col(row).isNotNull())
        .groupBy(F.col(key).cast("bigint").alias("record_id"), F.col(row).cast("bigint").alias("row_id"))
        .agg(F.min(loaded).alias("first_loaded"))
        .select(F.lit(table).alias("table_name"), "record_id", "row_id", "first_loaded")
    )


def orphan_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Keys with at least one orphan child: record_id, has_parent, deleted, parent_first, n_children.

    parents: record_id, first_loaded, deleted (one row each). Grouping is partial + final, so a key with a third of
    all children costs one partial row per task. Keys without children are dropped, so empty children give no row.
    """
    none = F.lit(None)
    long = parents.select(
        "record_id", F.lit(1).alias("p"), F.col("deleted").cast("int").alias("d"), F.col("first_loaded").alias("pf"), none.cast("timestamp_ntz").alias("cf"), F.lit(0).alias("c")
    ).unionByName(
        children.select(
            "record_id", F.lit(0).alias("p"), F.lit(0).alias("d"), none.cast("timestamp_ntz").alias("pf"), F.col("first_loaded").alias("cf"), F.lit(1).alias("c")
        )
    )
    keyed = long.groupBy("record_id").agg(
        F.max("p").alias("has_parent"), F.max("d").alias("deleted"), F.max("pf").alias("parent_first"), F.min("cf").alias("_child_first"), F.sum("c").alias("n_children")
    )
    bad = (F.col("has_parent") == 0) | (F.col("deleted") == 1) | (F.col("parent_first") > F.col("_child_first"))
    return keyed.where((F.col("n_children") > 0) & bad).drop("_child_first")


def orphan_rows(parents: DataFrame, children: DataFrame, n_rows: int) -> DataFrame:
    """table_name, record_id, row_id, reason ('missing', 'deleted', 'late'), period ('YYYY-MM', NULL if never loaded).

    n_rows: an upper bound on the number of children (a parquet count), used to tell hot keys.
    """
    keys = orphan_keys(parents, children)
    j = attach_by_key(children, keys, ["record_id"], "n_children", n_rows, F.col("row_id"))
    reason = (
        F.when(F.col("has_parent") == 0, "missing")
        .when(F.col("deleted") == 1, "deleted")
        .when(F.col("parent_first") > F.col("first_loaded"), "late")
    )
    return (
        j.withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("table_name", "record_id", "row_id", "reason", F.date_format("first_loaded", "yyyy-MM").alias("period"))
    )


def orphan_report(rows: DataFrame) -> DataFrame:
    """Orphans counted per table, period and reason."""
    return rows.groupBy("table_name", "period", "reason").agg(F.count("*").alias("n_rows"), F.countDistinct("record_id").alias("n_keys"))
