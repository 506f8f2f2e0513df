"""Many tiny files into few well-sized ones: size-tiered, level by level, with a journal.

plan_merges is the one rule: of each group files of one size tier are merged when at least FAN_IN of them exist.
CatalogueCompaction applies it to the catalogue of stored pieces (groups: a record's channel), Compactor to a folder of
parquet files (groups: partition folders), which it rewrites. Both go tier by tier, and every step is one journal entry
that names its inputs and outputs, created exclusively after the outputs are complete. Live files follow from the
journal, so a repeated, killed or raced step neither loses nor doubles a record.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import Store, attach_by_key, blank_trim
from .ordered import running_sum

#: Tier 0 holds files below BASE_BYTES, tier k those below BASE_BYTES * FAN_IN**k.
BASE_BYTES = 65_536
FAN_IN = 4
TARGET_BYTES = 32 << 20
HEADER_BYTES = 44
CHUNK = 512


#: Tiers in all: the last holds everything from BASE_BYTES * FAN_IN**(TIERS - 2) on.
TIERS = 24


def tier_of(n_bytes: Column, base: int = BASE_BYTES, fan_in: int = FAN_IN) -> Column:
    """Size tier of a file: 0 below base, then one more for each factor fan_in."""
    return sum((F.when(n_bytes >= base * fan_in**k, 1).otherwise(0) for k in range(TIERS - 1)), F.lit(0)).cast("int")


def whole_pieces(files: DataFrame) -> DataFrame:
    """The file kept of each stored piece: record_id, channel, piece_no, file_id, n_bytes, n_samples.

    Channels are compared without case and outer blanks; rows with NULL record_id or channel belong to no group. Whole
    is a file of header plus samples exactly; an unknown or NULL format, size or count is not. Of a piece the earliest
    written_at (NULL last), then the smallest file_id is kept, so repeated rows and second copies fall out.
    """
    width = F.when(F.col("sample_fmt") == "int16", 2).when(F.col("sample_fmt") == "float32", 4)
    whole = files.select(
        "record_id", F.lower(blank_trim(F.col("channel"))).alias("channel"), "piece_no", "file_id", "written_at", "n_bytes", "n_samples", (F.lit(HEADER_BYTES) + F.col("n_samples") * width).alias("_due")
    ).where(F.col("record_id").isNotNull() & F.col("channel").isNotNull() & F.col("file_id").isNotNull() & (F.col("n_bytes") == F.col("_due")))
    best = F.min(F.struct(F.col("written_at").isNull().alias("late"), "written_at", "file_id", "n_bytes", "n_samples")).alias("_f")
    return whole.groupBy("record_id", "channel", "piece_no").agg(best).select("record_id", "channel", "piece_no", "_f.file_id", "_f.n_bytes", "_f.n_samples")


def plan_merges(files: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column, min_files: int = FAN_IN, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """files of one tier (keys, file_id, n_bytes, ...) that are to be merged, with part: the number of their output.

    A group (keys) takes part from min_files files on. Its bytes are cut into as few equal shares as keep to
    target_bytes; neighbours by order whose middles lie in one share go into one output, and an output of one file is no
    merge: outputs are always fewer than inputs. Shares come from running sums over chunks of the order (see
    ordered.running_sum), so no task holds a hot group.
    """
    groups = files.groupBy(*keys).agg(F.count("*").alias("_n_files"), F.sum("n_bytes").alias("_total")).where(F.col("_n_files") >= min_files)
    chosen = attach_by_key(files, groups, keys, "_n_files", files.count(), F.col("file_id"))
    placed = running_sum(chosen, keys, order, F.col("n_bytes"), "_before", chunk)
    n_out = F.greatest(F.ceil(F.col("_total") / float(target_bytes)), F.lit(1))
    placed = placed.withColumn("part", F.floor((F.col("_before") + F.col("n_bytes") / 2.0) * n_out / F.col("_total")).cast("bigint"))
    # an output's inputs are bounded by its bytes
    inputs = F.count("*").over(W.partitionBy(*keys, "part"))
    return placed.withColumn("_k", inputs).where(F.col("_k") > 1).drop("_n_files", "_total", "_before", "_k")


_FILES = "record_id bigint, channel string, file_id string, first_piece bigint, last_piece bigint, n_bytes bigint, n_inputs bigint, level int, tier int"
_MERGES = "record_id bigint, channel string, part bigint, file_id string, first_piece bigint, last_piece bigint, n_bytes bigint, level int"


class CatalogueCompaction:
    """Size-tiered compaction of stored pieces on their catalogue, level by level, with a journal.

    Level k + 1 merges the files of tier k, stored ones and outputs of lower levels alike. Each level writes its merges
    (input by input, with the output's part) and its outputs, then one journal entry, created exclusively: a run that is
    repeated or resumed takes up behind the last entry, and half-written levels are not seen. Below the path: files/ and
    merges/ by level, _journal/.
    """

    def __init__(self, spark: SparkSession, path: str, min_files: int = FAN_IN, target_bytes: int = TARGET_BYTES):
        self.spark, self.path, self.min_files, self.target = spark, path.rstrip("/"), min_files, target_bytes
        self.store = Store(spark, self.path)

    def entries(self) -> dict[int, str | None]:
        """Run folder of each level that the journal has; None if there was nothing to merge."""
        names = [n for n in self.store.names("_journal") if n.endswith(".json")]
        return {int(n[:-5]): json.loads(self.store.read(f"_journal/{n}"))["run"] for n in names}

    def _read(self, kind: str, schema: str, levels: dict[int, str | None]) -> DataFrame:
        out = None
        for k, run in sorted(levels.items()):
            if run is None or kind == "merges" and k == 0:
                continue
            part = self.spark.read.schema(schema.replace(", level int", "")).parquet(f"{self.path}/{run}/{kind}/level={k}").withColumn("level", F.lit(k))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """Stored files (level 0) and outputs (from level 1 on), live or not."""
        return self._read("files", _FILES, self.entries())

    def merges(self, level: int | None = None) -> DataFrame:
        """Inputs of the merges (of one level): record_id, channel, part, file_id, pieces, n_bytes, level."""
        return self._read("merges", _MERGES, {k: r for k, r in self.entries().items() if level in (None, k)})

    def run(self, pieces: DataFrame) -> CatalogueCompaction:
        """pieces (record_id, channel, piece_no, file_id, n_bytes, each piece once) through every level."""
        run = f"run-{uuid.uuid4().hex}"
        done = self.entries()
        key = ["record_id", "channel"]
        if 0 not in done:
            stored = pieces.select(*key, F.col("file_id").cast("string").alias("file_id"), F.coalesce("piece_no", F.lit(0)).cast("bigint").alias("first_piece"), "n_bytes")
            stored = stored.withColumn("last_piece", F.col("first_piece")).withColumn("n_inputs", F.lit(1).cast("bigint")).withColumn("tier", tier_of(F.col("n_bytes")))
            self._commit(run, 0, stored)
            done[0] = run
        top = 0
        while BASE_BYTES * FAN_IN**top < self.target:
            top += 1
        for tier in range(top + 1):
            level = tier + 1
            if level in done:
                continue
            if not any(f"tier={tier}" in self.store.names(f"{r}/files/level={k}") for k, r in done.items() if r is not None):
                self._enter(level, None)
                done[level] = None
                continue
            live = self._read("files", _FILES, {k: r for k, r in done.items() if k < level}).where(F.col("tier") == tier)
            order = ["first_piece", "file_id"]
            m = plan_merges(live, key, order, F.floor(F.col("first_piece") / CHUNK), self.min_files, self.target)
            path = f"{self.path}/{run}/merges/level={level}"
            m.select(*key, "part", "file_id", "first_piece", "last_piece", "n_bytes").write.parquet(path)
            out = self.spark.read.schema(_MERGES.replace(", level int", "")).parquet(path).groupBy(*key, "part").agg(
                F.min("first_piece").alias("first_piece"), F.max("last_piece").alias("last_piece"), (F.sum(F.col("n_bytes") - HEADER_BYTES) + HEADER_BYTES).alias("n_bytes"), F.count("*").alias("n_inputs")
            )
            out = out.withColumn("file_id", F.concat_ws("-", F.lit(f"level{level}"), "record_id", "channel", "part")).withColumn("tier", tier_of(F.col("n_bytes")))
            self._commit(run, level, out.drop("part"))
            done[level] = run
        return self

    def _commit(self, run: str, level: int, files: DataFrame) -> None:
        files.write.partitionBy("tier").parquet(f"{self.path}/{run}/files/level={level}")
        self._enter(level, run)

    def _enter(self, level: int, run: str | None) -> None:
        if not self.store.create_once(f"_journal/{level:04d}.json", json.dumps({"run": run})):
            raise RuntimeError(f"another run compacted level {level}")


class Compactor:
    """Compaction of a folder of parquet files (partitioned or not) by size tiers, with journal.

    Live files are the folder's files that no journal entry names as input, plus the outputs of the entries until a later
    entry takes them. compact() lists the folder once, then merges tier by tier in batches of at most max_inputs files
    (only a batch's paths reach the driver), each batch one journal entry; files of different partition folders stay
    apart. read() reads the live files; vacuum() deletes files that entries have replaced. Records stay exactly the same
    multiset: a batch is committed only if its outputs have its inputs' number of rows and sum of row hashes.
    """

    def __init__(self, spark: SparkSession, path: str, base: int = 1 << 20, fan_in: int = FAN_IN, target: int = 128 << 20, max_inputs: int = 20_000):
        self.spark, self.path, self.base, self.fan_in, self.target, self.max_inputs = spark, path.rstrip("/"), base, fan_in, target, max(max_inputs, fan_in)
        self.store = Store(spark, self.path)
        self._raw = self.store.at("").toUri().getRawPath().rstrip("/")

    def entries(self) -> list[dict]:
        """Committed batches in order: {"folder": where outputs and the list of inputs stand, "rows": n, "tier": k}."""
        return [json.loads(self.store.read(f"_journal/{n}")) for n in self.store.names("_journal") if n.endswith(".json")]

    def _listed(self, where: str) -> DataFrame:
        """file_id (path below the folder, URL-encoded) and n_bytes of the parquet files below where; contents are not read."""
        b = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(where)
        return b.select(F.substring_index("_metadata.file_path", self._raw + "/", -1).alias("file_id"), F.col("_metadata.file_size").alias("n_bytes"))

    def live(self) -> DataFrame:
        """file_id, folder (its partition directory) and n_bytes of the live files."""
        files = self._listed(self.path)
        taken = None
        for e in self.entries():
            files = files.unionByName(self._listed(f"{self.path}/{e['folder']}/data"))
            inputs = self.spark.read.parquet(f"{self.path}/{e['folder']}/inputs")
            taken = inputs if taken is None else taken.unionByName(inputs)
        if taken is not None:
            files = files.join(taken, "file_id", "left_anti")
        inner = F.regexp_replace(F.col("file_id"), r"^_merged/[^/]+/data/__out=[^/]+/", "")
        return files.select("file_id", F.regexp_extract(inner, r"^(.*)/[^/]*$", 1).alias("folder"), "n_bytes")

    def _load(self, file_ids: Sequence[str]) -> DataFrame | None:
        """Rows of files, each set of outputs with its own base path, so partition columns come from the directories."""
        roots: dict[str, list[str]] = {}
        for f in sorted(file_ids):
            m = re.match(r"_merged/[^/]+/data", f)
            roots.setdefault(m[0] if m else "", []).append(f"{self.path}/{unquote(f)}")
        out = None
        for root, paths in roots.items():
            df = self.spark.read.option("mergeSchema", "true").option("basePath", f"{self.path}/{root}".rstrip("/")).parquet(*paths)
            df = df.withColumn("__file", F.substring_index("_metadata.file_path", self._raw + "/", -1)).drop("__out")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        files = [r.file_id for r in self.live().select("file_id").collect()]
        df = self._load(files)
        return df.drop("__file") if df is not None else None

    def compact(self) -> int:
        """Merges until no tier has fan_in files in a folder; returns the number of batches committed."""
        n, tier, edge = 0, 0, self.base
        while True:
            work = f"_plans/{uuid.uuid4().hex}"
            lo, hi = (0 if tier == 0 else edge // self.fan_in), min(edge, self.target)
            now = self.live().where((F.col("n_bytes") >= lo) & (F.col("n_bytes") < hi))
            now.write.parquet(f"{self.path}/{work}/files")
            files = self.spark.read.parquet(f"{self.path}/{work}/files").withColumn("_h", F.xxhash64("file_id"))
            m = plan_merges(files, ["folder"], ["_h", "file_id"], F.shiftright("_h", 50), self.fan_in, self.target)
            m.select("file_id", "folder", "part", "n_bytes").write.parquet(f"{self.path}/{work}/merges")
            merges = self.spark.read.parquet(f"{self.path}/{work}/merges")
            outs = merges.groupBy("folder", "part").agg(F.count("*").alias("k")).withColumn("_all", F.lit(0)).withColumn("_h", F.xxhash64("folder", "part"))
            outs = running_sum(outs, ["_all"], ["_h", "folder", "part"], F.col("k"), "_at", F.shiftright("_h", 50)).select("folder", "part", F.floor(F.col("_at") / self.max_inputs).alias("batch"))
            outs.write.parquet(f"{self.path}/{work}/outputs")
            planned = merges.join(self.spark.read.parquet(f"{self.path}/{work}/outputs"), ["folder", "part"])
            top = planned.agg(F.max("batch")).first()[0]  # one number
            for b in range(0 if top is None else int(top) + 1):
                n += self._batch(planned.where(F.col("batch") == b), tier)
            self.store.delete(work)
            if edge >= self.target:
                return n
            tier, edge = tier + 1, edge * self.fan_in

    def _batch(self, planned: DataFrame, tier: int) -> int:
        rows = planned.select("file_id", "folder", "part").collect()  # at most max_inputs and one output's inputs
        if not rows:
            return 0
        number = {k: i for i, k in enumerate(sorted({(r.folder, r.part) for r in rows}))}
        ids = [r.file_id for r in rows]
        df = self._load(ids)
        to = self.spark.createDataFrame([(r.file_id, number[r.folder, r.part]) for r in rows], "__file string, __out bigint")
        folder = f"_merged/{uuid.uuid4().hex}"
        parts = sorted({p.split("=", 1)[0] for r in rows for p in r.folder.split("/") if "=" in p})
        routed = df.join(F.broadcast(to), "__file").drop("__file").repartition(len(number), "__out")
        routed.write.partitionBy("__out", *parts).parquet(f"{self.path}/{folder}/data")
        self.spark.createDataFrame([(i,) for i in ids], "file_id string").write.parquet(f"{self.path}/{folder}/inputs")
        got = self.spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{folder}/data").drop("__out")
        before, after = self._sums(df.drop("__file")), self._sums(got)
        if before != after:
            raise RuntimeError("the outputs do not hold the records of the inputs; nothing was committed")
        k = len(self.store.names("_journal")) + 1
        if not self.store.create_once(f"_journal/{k:08d}.json", json.dumps({"folder": folder, "rows": before[0], "tier": tier})):
            raise RuntimeError("another compaction committed this entry")
        return 1

    @staticmethod
    def _sums(df: DataFrame) -> tuple[int, int]:
        cols = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        h = F.sum(F.pmod(F.xxhash64(*sorted(cols)), F.lit(1 << 30))) if cols else F.lit(0)
        r = df.agg(F.count("*").alias("n"), h.alias("h")).first()
        return r.n, r.h or 0

    def vacuum(self) -> int:
        """Deletes replaced files and outputs of batches that never committed; returns how many."""
        n, entries = 0, self.entries()
        for e in entries:
            for r in self.spark.read.parquet(f"{self.path}/{e['folder']}/inputs").toLocalIterator():
                p = unquote(r.file_id)
                n += bool(self.store.fs.exists(self.store.at(p)) and self.store.delete(p))
        named = {e["folder"] for e in entries}
        for name in self.store.names("_merged"):
            if f"_merged/{name}" not in named:
                n += self.store.delete(f"_merged/{name}")
        return n
