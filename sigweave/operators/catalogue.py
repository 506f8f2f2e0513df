"""Catalogue relations: records, their channels, files; keys, registration and selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import number_all


def record_id(*parts: Column) -> Column:
    """The digits of date and time as a bigint; NULL without digits."""
    return F.regexp_replace(F.concat_ws("", *[p.cast("string") for p in parts]), "[^0-9]", "").try_cast("bigint")


def channels_of(columns: Sequence[str]) -> list[str]:
    """Channels named by ch_<channel>_file columns."""
    return [m[1] for c in columns if (m := re.fullmatch(r"ch_(\w+)_file", c))]


def record_channels(records: DataFrame, key: str = "record_id") -> DataFrame:
    """Wide ch_<c>_file / ch_<c>_delay columns to long: key, channel, file, delay; channels without file left out."""
    rows = []
    for c in channels_of(records.columns):
        delay = F.col(f"ch_{c}_delay").cast("double") if f"ch_{c}_delay" in records.columns else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(c).alias("channel"), F.col(f"ch_{c}_file").alias("file"), delay.alias("delay")))
    if not rows:
        raise ValueError("no ch_<channel>_file column")
    return records.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*").where(F.col("file").isNotNull())


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row by order of each key, as one aggregation (no window, so hot keys combine map-side)."""
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c in rest]
    packed = F.struct(*[F.col(c) for c in lead], *[F.col(c) for c in rest if c not in lead])
    g = df.groupBy(*keys).agg(F.min(packed).alias("_f"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_f.{c}").alias(c) for c in df.columns])


def file_ids(files: DataFrame, order: Sequence[str]) -> DataFrame:
    """file_id: 0-based position by order over all files."""
    return number_all(files, list(order), "file_id")


def subset(tables: dict[str, DataFrame], by: str, where: str | Column, key: str = "record_id") -> dict[str, DataFrame]:
    """Rows of one table, and of every other one the rows of its records (left semi joins on key)."""
    chosen = tables[by].where(where)
    keys = chosen.select(key).distinct()
    return {n: chosen if n == by else t.join(keys, key, "left_semi") for n, t in tables.items()}


def add_file_info(records: DataFrame, files: DataFrame, id_col: str, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Columns of the file that id_col names, replacing earlier ones of that name; unknown files give NULL."""
    new = [f"{prefix}{c}" for c in columns]
    f = files.select(F.col("file_id").alias(id_col), *[F.col(c).alias(n) for c, n in zip(columns, new, strict=True)])
    return records.drop(*new).join(f, id_col, "left")


def register_channel(channels: DataFrame, mapping: DataFrame, known: str, new: str, key: str = "record_id", files: DataFrame | None = None) -> DataFrame:
    """Rows of a new channel whose file is mapped from a known channel's file; delays are copied.

    mapping: known_file, new_file. A known file mapped to several new ones raises, and so does a new file that files
    lacks; both checks are aggregations that bring back at most one row.
    """
    twice = mapping.groupBy("known_file").agg(F.countDistinct("new_file").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"ambiguous mapping of {twice[0].known_file}")
    if files is not None:
        lost = mapping.join(files.select(F.col("file").alias("new_file")), "new_file", "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"unknown file {lost[0].new_file}")
    one = mapping.groupBy("known_file").agg(F.min("new_file").alias("new_file"))
    base = channels.where(F.col("channel") == known)
    made = base.join(one, base["file"] == one["known_file"]).select(key, F.lit(new).alias("channel"), F.col("new_file").alias("file"), "delay")
    return channels.where(F.col("channel") != new).unionByName(made)


def channel_file_ids(channels: DataFrame, files: DataFrame, key: str = "record_id") -> DataFrame:
    """key, channel, file_id: each channel's file by name; of files of one name the smallest id, NULL if there is none."""
    by_name = files.groupBy("file").agg(F.min("file_id").alias("file_id"))
    return channels.select(key, "channel", "file").join(by_name, "file", "left").select(key, "channel", "file_id")


def add_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by file name: known names keep their file_id and take the new columns, others get max(file_id) + 1 onwards."""
    if new.groupBy("file").count().where("count > 1").limit(1).collect():
        raise ValueError("a file is given twice")
    top = files.agg(F.coalesce(F.max("file_id"), F.lit(-1))).first()[0]  # one number
    old = files.join(new.select("file"), "file", "left_anti")
    same = new.join(files.select("file", "file_id"), "file")
    fresh = number_all(new.join(files.select("file"), "file", "left_anti"), ["file"], "file_id", top + 1)
    return old.unionByName(same, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


def set_delay(channels: DataFrame, new: float, key: str = "record_id", channel: str | None = None) -> DataFrame:
    """All channels of a record shifted so that the reference (a channel, or the least delay) has the delay new."""
    ref = F.min(F.when(F.col("channel") == channel, F.col("delay")) if channel else F.col("delay")).alias("_ref")
    j = channels.join(channels.groupBy(key).agg(ref), key)
    return j.withColumn("delay", F.col("delay") + (F.lit(float(new)) - F.col("_ref"))).drop("_ref")


def factor_codes(df: DataFrame, column: str, out: str) -> DataFrame:
    """1-based codes of the sorted distinct values (a factor's levels); NULL stays NULL. Levels are joined, not windowed over rows."""
    levels = df.where(F.col(column).isNotNull()).select(column).distinct()
    return df.join(number_all(levels, [column], out, 1), column, "left")


def r_frame(df: DataFrame, factors: Sequence[str] = (), long_as_text: bool = True) -> DataFrame:
    """df as a statistics package without 64-bit integers and nested values takes it.

    bigint columns become text, factors get a column <name>_code of 1-based codes of their sorted values. Arrays, maps,
    structs and binary columns raise.
    """
    bad = [n for n, t in df.dtypes if t.startswith(("array", "map", "struct", "binary"))]
    if bad:
        raise ValueError(f"no plain columns: {bad}")
    for c in factors:
        df = factor_codes(df, c, f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code").cast("int"))
    return df.select(*[F.col(n).cast("string").alias(n) if t == "bigint" and long_as_text else F.col(n) for n, t in df.dtypes])
