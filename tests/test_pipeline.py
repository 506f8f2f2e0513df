"""Chains and small relations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.operators import intervals, pipeline
from sigweave.sources import folders, tables, wav

KEY = ["rid"]


def samples(spark, *series):
    return spark.createDataFrame([(r, i, float(v)) for r, s in enumerate(series) for i, v in enumerate(s)], "rid bigint, i bigint, v double")


def test_detection_of_two_bursts(spark):
    rate = 1000.0
    t = np.arange(4000) / rate
    x = np.sin(2 * np.pi * 100 * t) * (((t > 1) & (t < 1.5)) | ((t > 2.5) & (t < 3)))
    got = pipeline.detect(samples(spark, x), "rid", rate, 20, 10.0, (0.5, 0.2)).orderBy("start").collect()
    assert len(got) == 2 and abs(got[0].start - 1) < 0.1 and abs(got[1].end - 3) < 0.1


def test_match_within_a_range_and_robust(spark):
    tpl = [0.0, 1.0, 3.0, 1.0, 0.0]
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.01, 200)
    for at in (20, 120):
        x[at : at + 5] += tpl
    s = samples(spark, x)
    assert [r.start for r in pipeline.match(s, "rid", tpl, 1.0, 0.99).orderBy("start").collect()] == [20.0, 120.0]
    assert [r.start for r in pipeline.match(s, "rid", tpl, 1.0, 0.99, scan=(100, 150)).collect()] == [120.0]
    assert {20.0, 120.0} <= {r.start for r in pipeline.match(s, "rid", tpl, 1.0, robust=0.3).collect()}


def test_calculate_reports_failures(spark):
    a = spark.createDataFrame([(0, 0, 0.0, 2.0), (0, 1, 2.0, 3.0)], "rid bigint, annot_id bigint, start double, end double")
    got = {r.annot_id: r for r in pipeline.calculate(samples(spark, [1, 2, 3]), a, "rid", 1.0, {"m": np.mean, "bad": lambda x: x[1]}).collect()}
    assert (got[0].m, got[0].bad, got[0].error) == (1.5, 2.0, None) and got[1].m == 3.0 and got[1].bad is None and got[1].error == "bad: IndexError"


def test_shifts_zeros_and_slices(spark):
    with pytest.raises(ValueError):
        pipeline.shifted_delay(F.lit(0.0), F.lit(1.0), by=1.0, end=2.0)
    with pytest.raises(ValueError):
        pipeline.zeros(spark, {}, rate=1.0)
    assert pipeline.zeros(spark, {"a": 1}, 10.0, samples=7).count() == 7
    assert spark.range(1).select(pipeline.nearest_offset(F.lit(1.0), F.lit(1.26), 10.0)).first()[0] == 3
    s = samples(spark, [1, 2, 3])
    assert [r.v for r in pipeline.roll0(s, KEY, 1).orderBy("i").collect()] == [0.0, 1.0, 2.0]
    assert [r.v for r in pipeline.roll0(s, KEY, -2).orderBy("i").collect()] == [3.0, 0.0, 0.0]


def test_preprocess_keeps_other_channels(spark):
    s = samples(spark, [1, 2], [3, 4]).withColumn("channel", F.when(F.col("rid") == 0, "s"))
    got = {(r.rid, r.i): r.v for r in pipeline.preprocess(s, KEY, {"s": lambda x: -x}).collect()}
    assert got == {(0, 0): -1.0, (0, 1): -2.0, (1, 0): 3.0, (1, 1): 4.0}


def test_load_a_folder_tree(spark, tmp_path):
    for k, day in enumerate(("d1", "d2")):
        (tmp_path / day).mkdir()
        (tmp_path / day / "x.log").write_text(f"date\ttime\tch_s_file\n2024-01-0{k + 1}\t03.04.05\ta{k}.wav\n")
        sig = spark.createDataFrame([(f"a{k}.wav", 100.0, [0.1] * 50), ("same.wav", 100.0, [0.2] * 10)], "file string, rate double, samples array<double>")
        wav.write_wav(sig, str(tmp_path / day))
    ds = folders.load(spark, str(tmp_path), duration=True)
    got = {r.file: (r.file_id, r.channel, r.duration, r.folder) for r in ds.files.collect()}
    assert got == {"a0.wav": (0, "s", 0.5, "d1"), "same.wav": (1, None, 0.1, "d1"), "a1.wav": (2, "s", 0.5, "d2")}
    assert sorted((r.record_id, r.file_id) for r in ds.channels.collect()) == [(20240101030405, 0), (20240102030405, 2)]
    assert folders.load(spark, str(tmp_path), unknown_channels=False).files.count() == 2
    (tmp_path / "d3").mkdir()
    (tmp_path / "d3" / "x.log").write_text("date\ttime\tch_s_file\n2024-01-01\t03.04.05\tz.wav\n")
    with pytest.raises(ValueError):
        folders.load(spark, str(tmp_path))


def test_load_signals_and_folders_without_logs(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    sig = spark.createDataFrame([("a.wav", 100.0, [0.5, -0.5]), ("b.wav", 100.0, [0.25])], "file string, rate double, samples array<double>")
    wav.write_wav(sig, str(tmp_path / "d1"), normalize=False, sample_format="float32")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        folders.load(spark, str(tmp_path))
    ds = folders.load(spark, str(tmp_path), log_required=False, samples=True)
    assert sorted((r.record_id, r.channel, r.i, r.v) for r in ds.samples.collect()) == [(0, "s", 0, 0.5), (0, "s", 1, -0.5), (1, "s", 0, 0.25)]
    (tmp_path / "d1" / "x.log").write_text("date\ttime\tch_s_file\tch_vs_file\n2024-01-01\t03.04.05\ta.wav\tb.wav\n")
    ds = folders.load(spark, str(tmp_path), samples=True, preprocess={"s": lambda x: -x})
    assert sorted((r.channel, r.i, r.v) for r in ds.samples.collect()) == [("s", 0, -0.5), ("s", 1, 0.5), ("vs", 0, 0.25)]


def test_record_folder_and_npz(spark, tmp_path):
    rec = spark.createDataFrame([(7, "rig a", None)], "record_id bigint, rig string, note string")
    s = spark.createDataFrame([(7, "s", 100.0, [1.5, -2.0]), (7, "x[y", 50.0, [0.5])], "record_id bigint, channel string, rate double, samples array<double>")
    a = spark.createDataFrame([(7, 1, 0.5, None, "y", "t"), (7, 0, 0.0, 1.0, "x", "t"), (7, 0, 2.0, 3.0, "z", "u")], tables.ANNOTATION + ", annot_type string")
    folders.write_record_folder(rec, s, a, str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r" / "7").iterdir()) == ["7[s].wav", "7[x[y].wav", "7_annot[t].dat", "7_annot[u].dat", "7_record.dat"]
    r, got, ann = folders.read_record_folder(spark, str(tmp_path / "r"))
    assert r.first()["values"] == {"record_id": "7", "rig": "rig a", "note": None}
    assert sorted((x.channel, x.rate, x.samples) for x in got.collect()) == [("s", 100.0, [1.5, -2.0]), ("x[y", 50.0, [0.5])]
    assert sorted((x.annot_type, x.annot_id, x.start, x.end, x.comment) for x in ann.collect()) == [("t", 0, 0.0, 1.0, "x"), ("t", 1, 0.5, None, "y"), ("u", 0, 2.0, 3.0, "z")]
    np.savez(tmp_path / "m.npz", array=np.ones((2, 3)), y=np.array([5, 6]), times=np.arange(3.0), tjust=0.5)
    rows = folders.read_npz(spark, str(tmp_path / "*.npz")).orderBy("row").collect()
    assert [(r.y, r["values"], r.tjust) for r in rows] == [("5", [1, 1, 1], 0.5), ("6", [1, 1, 1], 0.5)]
    m = spark.createDataFrame([("m1", 0, "a", [1.0, 2.0], [0.0, 1.0], 0.5, 9, None), ("m1", 1, "b", [3.0, 4.0], [0.0, 1.0], 0.5, 8, "q")], "name string, row bigint, y string, values array<double>, times array<double>, tjust double, record_id bigint, note string")
    folders.write_npz(m, str(tmp_path / "n"))
    back = folders.read_matrix_rows(spark, str(tmp_path / "n"), "record_id bigint, note string")
    assert sorted(map(str, back.select(*m.columns).collect())) == sorted(map(str, m.collect()))


def test_as_of_join_and_record_position(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 4, "b"), (1, 6, "c")], "k int, t int, x string")
    assert sorted((r.k, r.t, r.x) for r in pipeline.last_before(left, right, ["k"], "t", "x").collect()) == [(1, 1, "a"), (1, 5, "b"), (2, 9, None)]
    rec = spark.createDataFrame([(3,), (1,), (2,)], "record_id bigint")
    assert pipeline.record_at(rec, 0).first()[0] == 1 and pipeline.record_at(rec, -1).first()[0] == 3 and pipeline.record_at(rec, 9).count() == 0


def test_ensemble_resampled(spark):
    s = samples(spark, [0, 0, 9, 9, 0, 0])
    e = pipeline.ensemble_of(s, intervals.segment_islands(s, 1, 2), "rid", 1.0, 2.0)
    assert e.count() == 6 and e.agg(F.max("v")).first()[0] == 9.0
