"""The registered text queries on the smallest data, on empty tables and with rows of nulls."""

import shutil
from pathlib import Path

import pytest

import __spark_entry__ as entry
from sigweave.llm import queries

NAMES = ["p6_pack", "p6_report", "p7_mix", "p7_report", "p7_shortage", "p7_shortage_report", "p8_found"]


def variant(spark, data, to, change):
    for p in Path(data).glob("*.parquet"):
        if p.stem == "documents":
            change(spark.read.parquet(str(p))).write.parquet(str(to / p.name))
        elif p.stem in ("pack_spec", "mix_target"):
            (shutil.copytree if p.is_dir() else shutil.copy)(p, to / p.name)
    return str(to)


def test_registered():
    assert set(NAMES) <= set(entry.queries()) and set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_on_empty_documents(spark, data, tmp_path, name):
    d = variant(spark, data, tmp_path, lambda x: x.limit(0))
    rows = entry.queries()[name](spark, d).collect()
    assert rows == [] or name in ("p7_report", "p7_shortage_report") and all(r.used_tokens == 0 for r in rows)


def test_rows_of_nulls_change_nothing(spark, data, tmp_path):
    d = variant(spark, data, tmp_path, lambda x: x.unionByName(spark.createDataFrame([tuple([None] * len(x.columns))] * 2, x.schema)))
    for name in ("p6_report", "p7_report", "p8_found"):
        f = entry.queries()[name]
        assert sorted(map(str, f(spark, d).collect())) == sorted(map(str, f(spark, data).collect())), name


def test_every_sentence_once_and_inside_its_text(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = [tuple(r) for r in entry.queries()["p8_found"](spark, data).collect()]
    assert len(got) == len(set(got)) > 1000
    # a no-break space may be the last byte of a garbled character
    assert all(0 <= e < len(docs[i]) and docs[i][e] not in " \t\r\n" for i, e in got)


def test_mix_keeps_to_its_targets(spark, data):
    for r in entry.queries()["p7_report"](spark, data).collect():
        assert r.most_uses <= r.max_repeat and (r.available_tokens == 0 or abs(r.actual_share - r.target_share / 0.97) < 0.1)
