"""Sources, sinks and streams: round trips."""

import numpy as np
from pyspark.sql import functions as F

from sigweave.operators import catalogue, intervals
from sigweave.sources import tables, wav
from sigweave.streaming import incremental


def test_wav_round_trip_with_log(spark, tmp_path):
    x = np.sin(np.arange(3000) / 20) * 3
    sig = spark.createDataFrame([("a.wav", 8000.0, x.tolist(), "s"), ("b.wav", 8000.0, [], "s")], "file string, rate double, samples array<double>, channel string")
    log = wav.write_wav(sig, str(tmp_path / "w"))
    got = {r.file: r for r in wav.read_wav(spark, str(tmp_path / "w"), log).collect()}
    assert np.allclose(got["a.wav"].samples, x, atol=3e-4) and got["a.wav"].rate == 8000.0 and got["b.wav"].n_samples == 0
    raw = wav.read_wav(spark, str(tmp_path / "w" / "a.wav")).first()
    assert max(np.abs(raw.samples)) <= 1 and raw.tjust == 0.5
    head = wav.read_wav(spark, str(tmp_path / "w"), header_only=True).orderBy("file").collect()
    assert [(r.n_samples, r.samples) for r in head] == [(3000, None), (0, None)]
    up = wav.upsert_log(log, log.where("file = 'a.wav'").withColumn("delay", F.lit(2.0)))
    assert sorted((r.file, r.delay) for r in up.collect()) == [("a.wav", 2.0), ("b.wav", 0.0)]


def test_wav_float_and_parts(spark, tmp_path):
    sig = spark.createDataFrame([("f.wav", 100.0, [5.0, -2.5] * 50)], "file string, rate double, samples array<double>")
    wav.write_wav(sig, str(tmp_path), normalize=False, sample_format="float32")
    parts = wav.read_wav(spark, str(tmp_path), part_samples=30).orderBy("first").collect()
    assert [(r.first, len(r.samples)) for r in parts] == [(0, 30), (30, 30), (60, 30), (90, 10)] and parts[0].samples[:2] == [5.0, -2.5]


def test_wav_channels_come_apart(spark, tmp_path):
    import struct

    x = np.arange(20, dtype="<i2").reshape(10, 2)
    head = b"RIFF" + struct.pack("<I", 36 + 8 + 40) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 2, 100, 400, 4, 16) + b"data" + struct.pack("<I", 40)
    (tmp_path / "two.WAV").write_bytes(head + x.tobytes())
    got = {(r.channel_no, r.first): r.samples for r in wav.read_files(spark, str(tmp_path), part_samples=6).collect()}
    assert got == {(c, f): x[f : f + 6, c].tolist() for c in (0, 1) for f in (0, 6)}
    assert [(r.channel_no, r.n_samples) for r in wav.read_files(spark, str(tmp_path), header_only=True).orderBy("channel_no").collect()] == [(0, 10), (1, 10)]
    (tmp_path / "none.wav").write_bytes(b"RIFX")
    try:
        wav.read_files(spark, str(tmp_path)).collect()
        raise AssertionError
    except Exception as e:
        assert "no RIFF WAVE file" in str(e)


def test_annotation_files(spark, tmp_path):
    rows = [(1, 0, 0.5, 1.5, "song", "a"), (1, 1, None, None, None, "a"), (2, 0, 1.0, 2.0, "", "b")]
    df = spark.createDataFrame(rows, tables.ANNOTATION + ", annot_type string")
    tables.write_annotations(df, str(tmp_path / "o"))
    back = tables.read_written_annotations(spark, str(tmp_path / "o"))
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, rows))
    (tmp_path / "x_annot[song].dat").write_text("record_id\tannot_id\tstart\tend\tcomment\n3\t0\t1.0\tNA\thello\n")
    got = tables.read_annotations(spark, str(tmp_path / "*.dat").replace("[", "\\[")).first()
    assert (got.record_id, got.end, got.annot_type) == (3, None, "song")


def test_logs_and_matrix(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "r.log").write_text("date\ttime\tch_s_file\tch_s_delay\n2024-01-02\t03.04.05\ta.wav\t0.5\n2024-01-02\tbad\tNA\tNA\n")
    r = tables.read_logs(spark, str(tmp_path / "*" / "*.log"))
    got = r.orderBy("time").collect()
    assert got[0].record_id == 20240102030405 and str(got[0].datetime) == "2024-01-02 03:04:05" and got[1].datetime is None and got[0].folder == "2024"
    assert [(x.channel, x.file, x.delay) for x in catalogue.record_channels(r).collect()] == [("s", "a.wav", 0.5)]
    assert tables.read_file_list(spark, str(tmp_path / "*" / "*.log")).first().file == "r.log"
    m = spark.createDataFrame([(1, [1.0, 2.0])], "rid bigint, values array<double>")
    tables.write_matrix(m, spark.sql("select array(0.0D, 1.0D) times, 1.0D rate"), str(tmp_path / "m"))
    rows, axis = tables.read_matrix(spark, str(tmp_path / "m"))
    assert rows.first()["values"] == [1.0, 2.0] and axis.first().rate == 1.0


def test_augment_takes_each_row_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "rid bigint, i bigint, v double"
    first = spark.createDataFrame([(1, 0, 9.0), (1, 1, 0.0)], schema)
    first.coalesce(1).write.parquet(src)
    run = lambda: incremental.augment(spark.readStream.schema(schema).parquet(src), lambda b: intervals.segment_islands(b, 1, 2), out, ck).awaitTermination(120)
    assert run() and spark.read.parquet(out).count() == 1
    assert run() and spark.read.parquet(out).count() == 1
    spark.createDataFrame([(0, 0, 9.0)], schema).coalesce(1).write.mode("append").parquet(src)  # a smaller id, later
    assert run() and spark.read.parquet(out).count() == 2


def _live(spark, tmp_path, batches, **options):
    src = str(tmp_path / "s")
    schema = "record_id bigint, s bigint, e bigint"
    q, out = None, []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        if q is None:
            q = incremental.live_periods(spark.readStream.schema(schema).parquet(src), **options).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        now = [tuple(r)[1:] for r in spark.table("live").collect()]
        out.append(sorted(now)[:])
    q.stop()
    return out


def test_live_periods_retract_what_they_absorb(spark, tmp_path):
    one, two = _live(spark, tmp_path, [[(1, 0, 10), (1, 10, 20), (1, 40, 50)], [(1, 15, 45)]], longest_gap=100)
    assert one == [("+", "gap", 20, 40, 0), ("+", "period", 0, 20, 2), ("+", "period", 40, 50, 1)]
    assert sorted(set(two) - set(one)) == [("+", "period", 0, 50, 4), ("-", "gap", 20, 40, 0), ("-", "period", 0, 20, 2), ("-", "period", 40, 50, 1)]


def test_live_periods_within_a_horizon(spark, tmp_path):
    _, last = _live(spark, tmp_path, [[(1, 0, 10), (1, 1000, 1010)], [(1, 5, 8), (1, 995, 1000)]], longest_gap=50, horizon=100)
    assert ("late", "interval", 5, 8, 1) in last and ("+", "period", 995, 1010, 2) in last and ("-", "period", 1000, 1010, 1) in last
