"""Queries of the text problems (p6 to p8). Their results are not expressible in SQL; tests/llm checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import checkpointed
from . import mixing, packing, sentences, tokens


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    spec = {r.pack_name: r.capacity_tokens for r in spark.read.parquet(f"{d}/pack_spec.parquet").collect()}  # a fixed table
    return packing.pack_texts(tokens.token_counts(_docs(spark, d), ["doc_id"]), spec)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(_packed(spark, d))


def _targets(spark: SparkSession, d: str) -> dict[str, tuple[float, int]]:
    rows = spark.read.parquet(f"{d}/mix_target.parquet").collect()  # a fixed table
    return {r.source.strip().lower(): (r.target_share, r.max_repeat) for r in rows}


#: p7_shortage asks for so many times the tokens at hand, more than some sources can give.
SHORT = 1.5
#: Subtitles of fewer cues are clips, the others programmes: the two domains of the budget tree.
CLIP_CUES = 20


def _mixed(spark: SparkSession, d: str, relative: float | None = None) -> tuple[DataFrame, dict]:
    domain = F.when(F.col("n_cues") < CLIP_CUES, "clip").otherwise("programme")
    docs = _docs(spark, d).withColumn("domain", domain)
    counted = checkpointed(tokens.token_counts(docs, ["doc_id", "lang", "source", "domain"], loss=False))
    targets = _targets(spark, d)
    return mixing.mix(counted, targets, relative=relative), targets


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].where(F.col("uses") > 0)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(*_mixed(spark, d))


def p7_shortage(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, SHORT)[0].where(F.col("uses") > 0)


def p7_shortage_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.tree_report(*_mixed(spark, d, SHORT), relative=SHORT)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(_docs(spark, d))


QUERIES = {"p6_pack": p6_pack, "p6_report": p6_report, "p7_mix": p7_mix, "p7_report": p7_report, "p7_shortage": p7_shortage, "p7_shortage_report": p7_shortage_report, "p8_found": p8_found}
SQL: dict[str, str] = {}
