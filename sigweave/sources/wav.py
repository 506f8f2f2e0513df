"""WAV files as a Spark source and sink, with the normalisation log as a side table.

Files are read and written through Arrow's file systems (local, HDFS, object stores), by tasks: Spark lists them, and
each task opens its own. One row a channel and part of at most part_samples samples; with header_only, or where only
headers are asked for, a file costs a few bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from ..operators.common import shipped
from .files import StagedWriter, open_path

SCHEMA = "path string, file string, rate double, channels int, channel_no int, n_samples bigint, format string, first bigint, samples array<double>"
INT16, FLOAT32 = "int16", "float32"


def read_header(f, size: int | None = None) -> tuple[int, int, str, int, int]:
    """rate, channels, sample format, offset of the samples, their bytes (at most what the file has); other chunks are skipped."""
    if size is None:
        size = f.seek(0, 2)
        f.seek(0)
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    fmt, at = None, 12
    while True:
        f.seek(at)
        chunk = f.read(8)
        if len(chunk) < 8:
            raise ValueError("no data chunk")
        n = struct.unpack("<I", chunk[4:])[0]
        if chunk[:4] == b"fmt ":
            tag, ch, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(16))
            fmt = {(1, 16): INT16, (3, 32): FLOAT32}.get((tag, bits))
            if fmt is None:
                raise ValueError(f"unsupported samples: format {tag}, {bits} bits")
        elif chunk[:4] == b"data":
            if fmt is None:
                raise ValueError("data before format")
            return rate, ch, fmt, at + 8, min(n, size - at - 8)
        at += 8 + n + n % 2


def file_rows(path: str, part_samples: int, header_only: bool) -> Iterator[dict]:
    """The rows of one file: parts of each channel, or with header_only a row a channel without samples."""
    where, name = open_path(path)
    with where.open_input_file(name) as f:
        rate, ch, fmt, at, size = read_header(f, f.size())
        dtype = np.dtype("<i2" if fmt == INT16 else "<f4")
        n = size // (dtype.itemsize * ch)
        row = {"path": path, "file": name.rsplit("/", 1)[-1], "rate": float(rate), "channels": ch, "n_samples": n, "format": fmt}
        if header_only or n == 0:
            for c in range(ch):
                yield row | {"channel_no": c, "first": 0, "samples": None if header_only else np.array([])}
            return
        f.seek(at)
        for first in range(0, n, part_samples):
            x = np.frombuffer(f.read(min(part_samples, n - first) * dtype.itemsize * ch), dtype).astype(float).reshape(-1, ch)
            for c in range(ch):
                yield row | {"channel_no": c, "first": first, "samples": x[:, c]}


def read_files(spark: SparkSession, path: str, header_only: bool = False, part_samples: int = 1 << 20, partition_bytes: int = 64 << 20) -> DataFrame:
    """Rows of the WAV files that a path or glob matches (see SCHEMA), samples as stored. A file that is none fails the read."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path).select("path", "length")
    total = b.agg(F.count("*").alias("n"), F.sum("length").alias("s")).first()  # two numbers
    parts = max(1, -(-(4096 * total.n if header_only else (total.s or 0)) // partition_bytes))
    names = [p.split()[0] for p in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in SCHEMA.split(", ")])

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for row in file_rows(p, part_samples, header_only):
                    yield pa.RecordBatch.from_arrays([pa.array([row[n]], schema.field(n).type) for n in names], schema=schema)

    return shipped(b.select("path").repartition(int(parts), "path")).mapInArrow(run, SCHEMA)


class WavWriter(StagedWriter):
    """One file a row: file, rate, samples. int16 multiplies by 32766 unless a value exceeds 1; float32 is as given."""

    def content(self, row) -> bytes:
        x, rate = np.asarray(row.samples, float), int(row.rate)
        if self.options.get("sample_format", INT16) == INT16:
            data = np.clip(np.round(x * 32766 if np.max(np.abs(x), initial=0) <= 1 else x), -32768, 32767).astype("<i2").tobytes()
            tag, bits = 1, 16
        else:
            data, tag, bits = x.astype("<f4").tobytes(), 3, 32
        head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 1, rate, rate * bits // 8, bits // 8, bits) + b"data" + struct.pack("<I", len(data))
        return head + data


class WavSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options, schema)


def read_wav(spark: SparkSession, path: str, log: DataFrame | None = None, header_only: bool = False, part_samples: int = 1 << 20) -> DataFrame:
    """Files under path with their samples scaled by the normalisation log: see SCHEMA, and the log's columns.

    log: file, norm_max, norm_min, norm_factor, delay, tjust, channel (a row a file). int16 samples of a file with all
    three factors become x / 2**15 * (max - min) / (2 * factor) + (max + min) / 2, without them x / 2**15; other formats
    stay as stored, and a log row for them makes samples NULL. Defaults: delay 0, tjust 0.5.
    """
    df = read_files(spark, path, header_only, part_samples)
    if log is None:
        log_cols = {c: F.lit(None).cast("double") for c in ("norm_max", "norm_min", "norm_factor")}
        df = df.select("*", *[v.alias(k) for k, v in log_cols.items()], F.lit(0.0).alias("delay"), F.lit(0.5).alias("tjust"), F.lit(None).cast("string").alias("channel"))
    else:
        df = df.join(log, "file", "left").withColumns({"delay": F.coalesce("delay", F.lit(0.0)), "tjust": F.coalesce("tjust", F.lit(0.5))})
    known = F.col("norm_max").isNotNull() & F.col("norm_min").isNotNull() & F.col("norm_factor").isNotNull()
    scaled = F.transform("samples", lambda x: x / 32768 * (F.col("norm_max") - F.col("norm_min")) / (2 * F.col("norm_factor")) + (F.col("norm_max") + F.col("norm_min")) / 2)
    plain = F.transform("samples", lambda x: x / 32768)
    value = F.when(F.col("format") == INT16, F.when(known, scaled).otherwise(plain)).otherwise(F.when(known, None).otherwise(F.col("samples")))
    return df.withColumn("samples", value)


def write_wav(signals: DataFrame, path: str, normalize: bool = True, factor: float = 0.999, sample_format: str = INT16) -> DataFrame:
    """Writes file, rate, samples (delay, tjust, channel optional) and returns the log rows that undo the scaling."""
    signals.sparkSession.dataSource.register(WavSink)
    top = F.array_max(F.transform("samples", lambda x: F.abs(x)))
    opt = lambda c, d: F.col(c) if c in signals.columns else d
    norm = bool(normalize)
    samples = F.when(top > 0, F.transform("samples", lambda x: x / top * factor)).otherwise(F.col("samples")) if norm else F.col("samples")
    shipped(signals).select("file", F.col("rate").cast("double").alias("rate"), samples.alias("samples")).write.format("wav").option("sample_format", sample_format).mode("append").save(path)
    return signals.select(
        "file", (top if norm else F.lit(None).cast("double")).alias("norm_max"), (-top if norm else F.lit(None).cast("double")).alias("norm_min"), F.lit(factor if norm else None).cast("double").alias("norm_factor"), opt("delay", F.lit(0.0)).alias("delay"), opt("tjust", F.lit(0.5)).alias("tjust"), opt("channel", F.lit(None).cast("string")).alias("channel")
    )


def upsert_log(log: DataFrame, new: DataFrame) -> DataFrame:
    """Log rows by file name: new ones replace old ones."""
    return log.join(new.select("file"), "file", "left_anti").unionByName(new)
