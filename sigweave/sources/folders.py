"""A folder tree of logs and WAV files as a data set, record folders, and matrices stored by numpy."""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators import catalogue
from ..operators.common import shipped
from . import tables, wav
from .files import write_files


def load(
    spark: SparkSession, root: str, log_glob: str = "*.log", wav_glob: str = "*.wav", date_format: str = "yyyy-MM-dd HH.mm.ss", rename: dict[str, str] | None = None, duration: bool = False,
    unknown_channels: bool = True, log_required: bool = True, samples: bool = False, preprocess: dict[str, Callable] | None = None,
) -> Dataset:
    """root/*/logs and files: records by the digits of date and time, channels in long form, files once by name.

    A file name met twice counts where its folder comes first. duration reads the files' headers. Files of no channel are
    kept unless unknown_channels is False. Logs that name the same date and time twice raise. Without any log it raises
    unless log_required is False: each file is then a record of its own, numbered from 0, of channel 's'. samples adds
    the signals (record_id, channel, i, v), preprocess by channel done to them.
    """
    try:
        records = tables.read_logs(spark, f"{root}/*/{log_glob}", date_format, rename)
    except AnalysisException as e:
        if log_required or "PATH_NOT_FOUND" not in str(e):
            raise
        records = None
    listed = catalogue.keep_first(tables.read_file_list(spark, f"{root}/*/{wav_glob}"), ["file"], ["folder", "path"])
    files = catalogue.file_ids(listed, ["folder", "file"])
    if records is None:
        records = files.select(F.col("file_id").alias("record_id"), F.lit(None).cast("timestamp_ntz").alias("datetime"), F.col("file").alias("ch_s_file"), "folder")
    twice = records.groupBy("record_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"record {twice[0].record_id} is logged twice")
    if duration:
        head = wav.read_wav(spark, f"{root}/*/{wav_glob}", header_only=True).groupBy("file").agg(F.max(F.col("n_samples") / F.col("rate")).alias("duration"))
        files = files.join(head, "file", "left")
    channels = catalogue.record_channels(records)
    of = channels.groupBy("file").agg(F.min("channel").alias("channel"))
    files = files.join(of, "file", "left" if unknown_channels else "inner")
    channels = channels.join(files.select("file", "file_id"), "file", "left")
    out = Dataset(records, channels, files)
    if not samples:
        return out
    w = wav.read_wav(spark, f"{root}/*/{wav_glob}").where("channel_no = 0").select("path", "file", "first", "samples")
    w = w.join(listed.select("path"), "path", "left_semi").join(channels.select("record_id", F.col("channel"), "file"), "file")
    long = w.select("record_id", "channel", "first", F.posexplode("samples").alias("k", "v")).select("record_id", "channel", (F.col("first") + F.col("k")).alias("i"), "v")
    if preprocess:
        from ..operators import pipeline

        long = pipeline.preprocess(long.withColumn("_ch", F.col("channel")), ["record_id", "channel"], preprocess, "_ch")
    return replace(out, samples=long)


def write_record_folder(records: DataFrame, signals: DataFrame, annots: DataFrame, path: str) -> None:
    """Records as folders of files: <id>/<id>_record.dat, <id>/<id>_annot[<type>].dat and <id>/<id>[<channel>].wav.

    records: record_id and columns (written as name and value, tab-separated); signals: record_id, channel, rate, samples
    (written as float32, so nothing is lost to scaling); annots: record_id, annot_type and columns. NULL is NA. An
    annotation table of a record and type is one small file, put together in one row.
    """
    rid = F.col("record_id").cast("string")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    lines = F.concat(*[F.concat(F.lit(f"{c}\t"), text(c), F.lit("\n")) for c in records.columns])
    files = records.select(F.concat(rid, F.lit("/"), rid, F.lit("_record.dat")).alias("file"), lines.cast("binary").alias("content"))
    cols = [c for c in annots.columns if c != "annot_type"]
    row = F.concat_ws("\t", *[text(c) for c in cols])
    g = annots.groupBy("record_id", "annot_type").agg(F.array_join(F.array_sort(F.collect_list(F.struct("annot_id", row.alias("t"))))["t"], "\n").alias("_t"))
    table = F.concat(F.lit("\t".join(cols) + "\n"), F.col("_t"), F.lit("\n"))
    named = F.concat(rid, F.lit("/"), rid, F.lit("_annot["), F.col("annot_type"), F.lit("].dat"))
    write_files(files.unionByName(g.select(named.alias("file"), table.cast("binary").alias("content"))), path)
    s = signals.select(F.concat(rid, F.lit("/"), rid, F.lit("["), F.col("channel"), F.lit("].wav")).alias("file"), "rate", "samples")
    wav.write_wav(s, path, normalize=False, sample_format=wav.FLOAT32)


def read_record_folder(spark: SparkSession, path: str, annotation: str = tables.ANNOTATION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What write_record_folder wrote: records (record_id, values: a map), signals (record_id, channel, rate, first, samples)
    and annotations (the columns named, annot_type)."""
    rec = spark.read.text(f"{path}/*/*_record.dat").select(F.col("_metadata.file_path").alias("p"), F.split("value", "\t", 2).alias("c")).where(F.size("c") == 2)
    rec = rec.select("p", F.col("c")[0].alias("k"), F.when(F.col("c")[1] != "NA", F.col("c")[1]).alias("v")).groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("values"))
    records = rec.select(F.try_element_at("values", F.lit("record_id")).cast("bigint").alias("record_id"), "values")
    w = wav.read_files(spark, f"{path}/*")
    name = r"([0-9]+)\[([^\]]*)\]\.wav$"
    signals = w.select(F.regexp_extract("file", name, 1).cast("bigint").alias("record_id"), F.regexp_extract("file", name, 2).alias("channel"), "rate", "first", "samples").where("record_id is not null")
    return records, signals, tables.read_annotations(spark, f"{path}/*/*_annot*.dat", annotation)


def write_npz(rows: DataFrame, path: str) -> None:
    """Matrices as <name>.npz (array, y, times, tjust) and <name>_db.dat: name, row, y, values, times, tjust and row columns.

    A matrix is put together in one task; the columns besides these go to the table, tab-separated, NULL as NA.
    """
    extra = [c for c in rows.columns if c not in ("name", "row", "y", "values", "times", "tjust")]

    def fn(key, pdf):
        pdf = pdf.sort_values("row")
        buf = io.BytesIO()
        np.savez_compressed(buf, array=np.array([np.asarray(v, float) for v in pdf["values"]]), y=pdf["y"].to_numpy(str), times=np.asarray(pdf["times"].iloc[0], float), tjust=float(pdf["tjust"].iloc[0]))
        files = [(f"{key[0]}.npz", buf.getvalue())]
        if extra:
            files.append((f"{key[0]}_db.dat", pdf[extra].to_csv(sep="\t", index=False, na_rep="NA").encode()))
        return pd.DataFrame(files, columns=["file", "content"])

    write_files(shipped(rows).groupBy("name").applyInPandas(fn, "file string, content binary"), path)


def read_npz(spark: SparkSession, glob: str) -> DataFrame:
    """Matrices in .npz files (array, y, times, tjust): a row per matrix row: path, row, y, values, times, tjust."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    times = [float(x) for x in z["times"]]
                    for k, v in enumerate(z["array"]):
                        rows.append((p, k, str(z["y"][k]), [float(x) for x in v], times, float(z["tjust"])))
            yield pd.DataFrame(rows, columns=["path", "row", "y", "values", "times", "tjust"])

    b = spark.read.format("binaryFile").load(glob).select("path", "content")
    return b.mapInPandas(run, "path string, row bigint, y string, values array<double>, times array<double>, tjust double")


def read_matrix_rows(spark: SparkSession, path: str, db: str) -> DataFrame:
    """Matrices and their tables (db: its columns in order, as DDL) put together by file name and row."""
    m = read_npz(spark, f"{path}/*.npz").withColumn("name", F.regexp_extract("path", r"([^/]+)\.npz$", 1)).drop("path")
    names = [c.split()[0] for c in db.split(",")]
    t = spark.read.text(f"{path}/*_db.dat", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)_db\.dat$", 1).alias("name"), F.split(F.rtrim("value"), "\n").alias("l"))
    t = t.select("name", F.posexplode(F.slice("l", 2, F.size("l"))).alias("row", "line")).select("name", F.col("row").cast("bigint").alias("row"), F.from_csv("line", db, {"sep": "\t", "nullValue": "NA"}).alias("c"))
    return m.join(t.select("name", "row", *[F.col(f"c.{n}").alias(n) for n in names]), ["name", "row"], "left")
