"""Only new or changed records: persisted key and content-hash state, joined with the current rows.

State lives in a folder as immutable parquet segments; a numbered manifest under _versions names the segments of a
version. A plan writes the keys due as a segment and remembers the version it saw; its commit creates the next manifest
exclusively, naming that segment: that single create is the atomic swap. A run that dies before it leaves an unreferenced
segment and nothing else, so its keys come again; a run that got through it never sees them again. Of two runs racing
for one version, one fails cleanly.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store, content_hash

HASH = "content_hash"


def with_hash(rows: DataFrame, keys: Sequence[str], content: Sequence[Column]) -> DataFrame:
    """(keys, content_hash) of rows; rows with a NULL key have no key and are left out."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    return rows.select(*keys, content_hash(*content).alias(HASH))


def state_from_history(done: DataFrame, runs: DataFrame, keys: Sequence[str], content: Sequence[Column]) -> DataFrame:
    """State as the successful runs left it: per key the hash seen by the greatest run_id with status 'ok'.

    Rows of other runs are ignored, repeated rows are equal. runs joins as a plain equi-join, which Spark turns
    into a broadcast only if its measured size allows.
    """
    ok = runs.where(F.col("status") == "ok").select("run_id").distinct()
    seen = done
    for k in keys:
        seen = seen.where(F.col(k).isNotNull())
    seen = seen.select("run_id", *keys, content_hash(*content).alias(HASH)).join(ok, "run_id")
    return seen.groupBy(*keys).agg(F.max(F.struct("run_id", HASH)).alias("_s")).select(*keys, F.col(f"_s.{HASH}").alias(HASH))


def new_or_changed(current: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of current (one row per key, with content_hash) that state lacks or holds with another hash.

    Result: keys, content_hash, change ('new' or 'changed'). An empty state makes every key new, an empty current
    gives no row; keys only in state are not reported.
    """
    known = state.select(*keys, F.col(HASH).alias("_known"))
    j = current.select(*keys, HASH).join(known, list(keys), "left")
    return j.where(F.col("_known").isNull() | (F.col("_known") != F.col(HASH))).select(
        *keys, HASH, F.when(F.col("_known").isNull(), "new").otherwise("changed").alias("change")
    )


@dataclass(frozen=True)
class Plan:
    """Keys to handle now (due: keys, content_hash, change), as written in a segment, and the version they were planned on."""

    due: DataFrame
    segment: str
    version: int


class ChangeTracker:
    """Exactly-once selection of new and changed keys over repeated runs.

    plan(rows) writes the keys to handle as a segment and hands that out; commit(plan) after the work succeeded makes the
    same segment part of the state. What arrives between the two is neither handled nor recorded, so it comes in the next
    plan. Nothing is recorded without a commit, and a plan made on a version that another run has replaced cannot be
    committed. Segments are merged into one when a version would name more than max_segments of them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], content: Sequence[Column] = (), max_segments: int = 8):
        self.spark, self.path, self.keys, self.content, self.max_segments = spark, path.rstrip("/"), list(keys), list(content), max_segments
        self.store = Store(spark, self.path)

    def version(self) -> int:
        """Number of the latest version, 0 before the first commit."""
        return max((int(n[:-5]) for n in self.store.names("_versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def segments(self, version: int | None = None) -> list[str]:
        v = self.version() if version is None else version
        return json.loads(self.store.read(f"_versions/{v:010d}.json"))["segments"] if v else []

    def _read(self, segments: list[str]) -> DataFrame | None:
        if not segments:
            return None
        parts = [self.spark.read.parquet(f"{self.path}/{s}").select(*self.keys, HASH, F.lit(i).alias("_seq")) for i, s in enumerate(segments)]
        if len(parts) == 1:
            return parts[0].drop("_seq")
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        top = rows.groupBy(*self.keys).agg(F.max(F.struct("_seq", HASH)).alias("_s"))
        return top.select(*self.keys, F.col(f"_s.{HASH}").alias(HASH))

    def _write(self, rows: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _swap(self, before: int, names: list[str]) -> int:
        if not self.store.create_once(f"_versions/{before + 1:010d}.json", json.dumps({"segments": names})):
            raise RuntimeError(f"version {before + 1} was committed by another run")
        return before + 1

    def state(self) -> DataFrame | None:
        """The latest state (keys, content_hash), None before the first commit."""
        return self._read(self.segments())

    def seed(self, state: DataFrame) -> int:
        """First version from a state known otherwise (keys, content_hash; one row a key)."""
        return self._swap(0, [self._write(state.select(*self.keys, HASH))])

    def plan(self, rows: DataFrame) -> Plan:
        """rows (one per key) hashed and joined with the state."""
        return self.plan_hashed(with_hash(rows, self.keys, self.content))

    def plan_hashed(self, current: DataFrame) -> Plan:
        """As plan, of rows (keys, content_hash)."""
        version = self.version()
        state = self._read(self.segments(version))
        due = new_or_changed(current, state, self.keys) if state is not None else current.select(*self.keys, HASH, F.lit("new").alias("change"))
        name = self._write(due)
        return Plan(self.spark.read.parquet(f"{self.path}/{name}"), name, version)

    def commit(self, plan: Plan) -> int:
        """Makes the plan's segment part of the state; returns the new version. Raises if another run was faster."""
        names = [*self.segments(plan.version), plan.segment]
        if len(names) > self.max_segments:
            names = [self._write(self._read(names))]
        return self._swap(plan.version, names)
