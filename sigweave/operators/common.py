"""Small building blocks shared by the operators: blanks, milliseconds, hashes, current rows, skew."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\u00a0"
#: A group is hot if it holds more than this share of all rows, so there are at most so many hot groups.
HOT_GROUPS = 512
SALTS = 256


def blank_trim(col: Column, extra: str = "") -> Column:
    """col without outer blanks (and without the characters of extra at its ends)."""
    return F.btrim(col, F.lit(BLANKS + extra))


def to_ms(seconds: Column) -> Column:
    """Seconds (double) to whole milliseconds (bigint), half up; NULL, NaN and what no bigint holds give NULL."""
    return F.when(~F.isnan(seconds) & (F.abs(seconds) < 9e12), F.floor(seconds * 1000 + F.lit(0.5)))


def content_hash(*cols: Column) -> Column:
    """64-bit hash of cols that keeps NULL apart from every value and from a shift of the columns."""
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def current_rows(
    df: DataFrame,
    keys: Sequence[str],
    values: dict[str, Column],
    updated: str = "updated_at",
    loaded: str = "loaded_at",
) -> DataFrame:
    """One row per non-NULL key: values of its row with the greatest updated (NULL oldest), then loaded.

    Also yields first_loaded, the key's smallest loaded. Rows still tied are taken as equal; the greatest
    values win, so the result is deterministic. Repeated rows change nothing; an empty input gives no row.
    It is one partial + final aggregation: a key with a third of all rows is combined before the shuffle.
    """
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    packed = F.struct(F.col(updated).alias("_updated"), F.col(loaded).alias("_loaded"), *[v.alias(n) for n, v in values.items()])
    out = df.groupBy(*keys).agg(F.max(packed).alias("_cur"), F.min(loaded).alias("first_loaded"))
    return out.select(*keys, "first_loaded", *[F.col(f"_cur.{n}").alias(n) for n in values])


def attach_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    weight: str,
    n_rows: int | Column,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """rows joined with table (at most one row per key), however skewed the keys of rows are.

    weight names table's column holding the number of rows of that key, n_rows an upper bound on all rows (a number or
    a scalar column).
    Keys with more than n_rows / HOT_GROUPS rows number fewer than HOT_GROUPS: that part of table is broadcast,
    a proven bound. Rows of hot keys then go through the shuffle join under a salt made from spread and match
    nothing there, so no reducer gets a hot key's rows. NULL keys match nothing.
    """
    extra = [c for c in table.columns if c not in keys]
    limit = F.greatest(F.lit(1), F.floor(n_rows / HOT_GROUPS)) if isinstance(n_rows, Column) else max(1, n_rows // HOT_GROUPS)
    hot = F.broadcast(table.where(F.col(weight) > limit).select(*keys, F.struct(*extra).alias("_hot")))
    salted = rows.join(hot, list(keys), "left").withColumn(
        "_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int") + 1)
    )
    cold = table.select(*keys, F.struct(*extra).alias("_cold"), F.lit(0).alias("_salt"))
    out = salted.join(cold, [*keys, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    if how == "inner":
        out = out.where(F.col("_got").isNotNull())
    kept = [c for c in rows.columns if c not in extra]
    return out.select(*kept, *[F.col(f"_got.{c}").alias(c) for c in extra])


def carry_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, chunk: int = 256
) -> DataFrame:
    """Adds out: the last non-NULL value of the key's rows with a smaller order (order: integer, unique per key).

    The order is cut into chunks: a window inside each chunk (at most chunk rows), a window along the key over one row a
    chunk only (the other rows are parted from it by their chunk), and the result handed to the chunk. df is computed
    once, and no task sorts a whole hot key.
    """
    from pyspark.sql import Window as W

    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    inner = W.partitionBy(*keys, "_chunk").orderBy(order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    before = inner.rowsBetween(W.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.last(value, ignorenulls=True).over(before)).withColumn("_end", F.last(value, ignorenulls=True).over(upto)).withColumn("_last", F.lead(F.lit(True)).over(inner).isNull())
    along = W.partitionBy(*keys, F.when(~F.col("_last"), F.col("_chunk"))).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = local.withColumn("_carry", F.when(F.col("_last"), F.last("_end", ignorenulls=True).over(along)))
    whole = W.partitionBy(*keys, "_chunk")
    return carried.withColumn("_carry", F.max("_carry").over(whole)).select(*df.columns, F.coalesce("_local", "_carry").alias(out))


def shared_dir(spark: SparkSession, prefix: str = "sigweave") -> str:
    """A fresh path under spark.checkpoint.dir, which all executors share.

    Where that is unset, a local folder serves a session on one machine; on a cluster it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sigweave-")
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


class Store:
    """Small text files of a folder, created once and never changed, and its Hadoop file system.

    create_once is exclusive: a hard link on local disks and mounted folders (an exclusive open where they have none), a
    rename that refuses to replace on HDFS-like systems. Where a rename is a copy (object stores) neither holds, so their
    schemes raise.
    """

    RENAMES = {"hdfs", "viewfs", "ofs", "abfs", "abfss"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at("").getFileSystem(self._conf)
        self.scheme = self.fs.getUri().getScheme()

    def at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it does not exist."""
        p = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.at(name), True))

    def create_once(self, name: str, text: str) -> bool:
        """Creates the file with its whole text; False, and nothing done, if it exists. Of several at once one gets True."""
        folder, base = name.rsplit("/", 1)
        staged = f"{folder}/_{uuid.uuid4().hex}"
        if self.scheme == "file":
            target, part = (self.at(n).toUri().getPath() for n in (name, staged))
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(part, "w", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            except OSError:  # a mounted folder without hard links: exclusive all the same, but written after it is made
                return self._create_exclusive(target, text)
            finally:
                os.remove(part)
            return True
        if self.scheme not in self.RENAMES:
            raise ValueError(f"{self.scheme}: no exclusive creation of files is known for this file system")
        return self._create_by_rename(name, staged, text)

    @staticmethod
    def _create_exclusive(target: str, text: str) -> bool:
        try:
            with open(target, "x", encoding="utf-8") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            return True
        except FileExistsError:
            return False

    def _create_by_rename(self, name: str, staged: str, text: str) -> bool:
        out = self.fs.create(self.at(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(self.fs.getUri(), self._conf)
        option = self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 1)
        options[0] = option.getEnumConstants()[0]  # NONE: an existing target is an error
        try:
            context.rename(self.at(staged), self.at(name), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.delete(staged)
            return False


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage through the reliable checkpoint folder of the session."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def shipped(df: DataFrame) -> DataFrame:
    """df, with this package made importable in the session's Python workers (a zip of its sources, sent once)."""
    import zipfile

    sc = df.sparkSession.sparkContext
    if not getattr(sc, "_sigweave_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="sigweave-"), "sigweave.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.join("sigweave", os.path.relpath(path, root)))
        sc.addPyFile(target)
        sc._sigweave_shipped = True
    return df
