"""Text and matrix folders: recording logs, annotation tables, record folders, time matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalogue import record_id

ANNOTATION = "record_id bigint, annot_id bigint, start double, end double, comment string"


def read_annotations(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """Tab-separated annotation files; the type of each comes from its name: annot[type].dat. 'NA' is NULL."""
    df = spark.read.csv(path, sep="\t", header=True, nullValue="NA", schema=schema, enforceSchema=True, escape='"')
    return df.withColumn("annot_type", F.regexp_extract(F.col("_metadata.file_name"), r"annot(?:\[|%5B)([^\]%]*)", 1))


def write_annotations(annots: DataFrame, path: str) -> None:
    """Tab-separated, NULL as 'NA', a folder per annot_type where that column exists."""
    w = annots.write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (w.partitionBy("annot_type") if "annot_type" in annots.columns else w).csv(path)


def read_written_annotations(spark: SparkSession, path: str, schema: str = ANNOTATION) -> DataFrame:
    """What write_annotations wrote."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA", emptyValue="", schema=schema + ", annot_type string", pathGlobFilter="*.csv")


def read_logs(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd HH.mm.ss", rename: dict[str, str] | None = None) -> DataFrame:
    """Recording logs (tab-separated, with date and time) as records: record_id, datetime and the logs' columns.

    Rows whose date and time do not parse keep a NULL datetime; duplicates are left to catalogue.keep_first.
    """
    df = spark.read.option("mergeSchema", True).csv(path, sep="\t", header=True, nullValue="NA")
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    if not {"date", "time"} <= set(df.columns):
        raise ValueError("a log needs date and time")
    at = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit(date_format)).cast("timestamp_ntz")
    return df.withColumn("record_id", record_id(F.col("date"), F.col("time"))).withColumn("datetime", at).withColumn("folder", F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, file, n_bytes of the files a glob matches; their content is not read."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("n_bytes"))


def write_matrix(rows: DataFrame, axis: DataFrame, path: str) -> None:
    """A time matrix: its rows (values array and row columns) and its axis (times, rate, tjust)."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    axis.write.mode("overwrite").parquet(f"{path}/axis")


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/axis")
