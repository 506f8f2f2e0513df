"""The general data problems on small cases: nulls, ties, repeats, empty tables, clashing columns, skew, failures."""

import datetime as dt
import random

import brute_drift
import pytest
from pyspark.sql import functions as F

from sigweave.operators import changes, common, compaction, drift, orphans, ordered, periods

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


# ---- current rows, skew and carries


def test_current_rows_null_oldest_ties_and_empty(spark):
    rows = [(1, at(5), None, "a"), (1, at(1), at(0), "b"), (1, at(2), at(0), "c"), (1, at(2), at(0), "c"), (None, at(0), at(0), "x")]
    df = spark.createDataFrame(rows, "k bigint, loaded_at timestamp_ntz, updated_at timestamp_ntz, v string")
    got = common.current_rows(df, ["k"], {"v": F.col("v")}).collect()
    assert [(r.k, r.v, r.first_loaded) for r in got] == [(1, "c", at(1))]
    assert common.current_rows(df.limit(0), ["k"], {"v": F.col("v")}).count() == 0


def test_content_hash_keeps_nulls_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("", None)], "x string, y string")
    assert df.select(common.content_hash(F.col("x"), F.col("y"))).distinct().count() == 4


def test_attach_by_key_with_a_hot_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), (F.max("id") + 1).alias("top"))
    got = common.attach_by_key(rows, table, ["k"], "n", 3000, F.col("id"))
    want = rows.join(table, "k")
    assert sorted(map(tuple, got.select("k", "id", "n", "top").collect())) == sorted(map(tuple, want.select("k", "id", "n", "top").collect()))


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_carry_forward_over_chunks(spark, chunk):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, i * 10])) for k in range(3) for i in range(50)]
    got = common.carry_forward(spark.createDataFrame(rows, "k int, i bigint, v int"), ["k"], "i", "v", "last", chunk).collect()
    last = {}
    for k, i, v in rows:
        last[k, i] = last.get((k, i - 1, "v"))
        last[k, i, "v"] = v if v is not None else last[k, i]
    assert {(r.k, r.i): r["last"] for r in got} == {key: v for key, v in last.items() if len(key) == 2}


def test_number_rows_and_halo(spark):
    rows = [(k, i) for k in "ab" for i in range(100)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t bigint")
    got = ordered.number_rows(df, ["k"], ["t"], "n", F.floor(F.col("t") / 7)).collect()
    assert all(r.n == r.t for r in got) and len(got) == 200
    h, w = ordered.with_halo(df, ["k"], "t", 2, 1, chunk=8)
    out = ordered.own_rows(h.withColumn("p", F.lag("t", 2).over(w)).withColumn("q", F.lead("t").over(w))).collect()
    assert len(out) == 200
    assert all(r.p == (r.t - 2 if r.t >= 2 else None) and r.q == (r.t + 1 if r.t < 99 else None) for r in out)


# ---- p1


def test_changes_exactly_once_over_failures(spark, tmp_path):
    t = changes.ChangeTracker(spark, str(tmp_path / "state"), ["k"], [F.col("v")], max_segments=2)
    v1 = spark.createDataFrame([(1, "a"), (2, None), (None, "x")], "k bigint, v string")
    first = t.plan(v1)
    assert sorted((r.k, r.change) for r in first.due.collect()) == [(1, "new"), (2, "new")]
    # the run dies before its commit: everything comes again
    assert t.plan(v1).due.count() == 2
    t.commit(first)
    assert t.plan(v1).due.count() == 0
    v2 = spark.createDataFrame([(1, "a"), (2, ""), (3, None)], "k bigint, v string")
    assert sorted((r.k, r.change) for r in t.plan(v2).due.collect()) == [(2, "changed"), (3, "new")]
    # a commit that dies before the swap leaves a segment nobody names
    t.plan(v2).due.select("k", "content_hash").write.parquet(str(tmp_path / "state" / "segment-orphan"))
    assert t.plan(v2).due.count() == 2
    for _ in range(3):
        t.commit(t.plan(v2))
    assert t.version() == 4 and len(t.segments()) <= 3 and t.plan(v2).due.count() == 0


def test_rows_that_arrive_before_the_commit_are_not_skipped(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string").write.parquet(source)
    t = changes.ChangeTracker(spark, str(tmp_path / "state"), ["k"], [F.col("v")])
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    plan = t.plan(spark.read.schema("k bigint, v string").parquet(source))
    spark.createDataFrame([(3, "c")], "k bigint, v string").write.mode("append").parquet(source)
    t.commit(plan)
    assert t.state().count() == 2 and rows.count() == 2
    assert [r.k for r in t.plan(spark.read.parquet(source)).due.collect()] == [3]


def test_of_two_runs_from_one_version_one_fails(spark, tmp_path):
    t = changes.ChangeTracker(spark, str(tmp_path / "state"), ["k"], [F.col("v")])
    old, new = (t.plan(spark.createDataFrame([(1, v)], "k bigint, v string")) for v in ("old", "new"))
    t.commit(new)
    with pytest.raises(RuntimeError):
        t.commit(old)
    assert t.version() == 1 and t.plan(spark.createDataFrame([(1, "new")], "k bigint, v string")).due.count() == 0
    with pytest.raises(RuntimeError):
        t.seed(t.state())


def test_files_created_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = common.Store(spark, str(tmp_path / "s"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: store.create_once("a/one", str(k)), range(8)))
    assert won.count(True) == 1 and store.read("a/one") == str(won.index(True)) and store.names("a") == ["one"]
    assert store._create_by_rename("a/two", "a/_x", "2") and not store._create_by_rename("a/two", "a/_y", "3")
    assert store.read("a/two") == "2" and store.names("none") == []
    assert store._create_exclusive(str(tmp_path / "s" / "a" / "three"), "3") and not store._create_exclusive(str(tmp_path / "s" / "a" / "three"), "4")
    assert store.read("a/three") == "3"
    store.scheme = "s3a"
    with pytest.raises(ValueError):
        store.create_once("a/four", "")


def test_state_ignores_runs_that_failed(spark):
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "killed"), (4, "ok")], "run_id int, status string")
    done = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "a"), (4, 2, "c"), (4, 2, "c"), (3, 3, "z"), (1, None, "q")], "run_id int, k bigint, v string")
    state = changes.state_from_history(done, runs, ["k"], [F.col("v")])
    cur = changes.with_hash(spark.createDataFrame([(1, "a"), (2, "a"), (3, "z")], "k bigint, v string"), ["k"], [F.col("v")])
    assert sorted((r.k, r.change) for r in changes.new_or_changed(cur, state, ["k"]).collect()) == [(2, "changed"), (3, "new")]
    assert changes.new_or_changed(cur, state.limit(0), ["k"]).count() == 3


# ---- p2


def test_merge_plan_whole_pieces_and_ties(spark, tmp_path):
    cols = "file_id bigint, record_id bigint, channel string, piece_no bigint, sample_fmt string, n_samples bigint, n_bytes bigint, written_at timestamp_ntz, extra int"
    ok = lambda f, r, c, p, w=0, n=100: (f, r, c, p, "int16", n, 44 + 2 * n, at(w) if w is not None else None, 0)
    rows = [ok(i, 1, "s" if i % 2 else " S ", i) for i in range(5)]
    rows += [ok(10, 1, "s", 0, 5), ok(11, 1, "s", 0, None), (12, 1, "s", 9, "int16", 100, 100, at(0), 0), (13, 1, "s", 9, "wav", 1, 46, at(0), 0)]
    rows += [ok(20, None, "s", 1), ok(21, 1, None, 1), ok(0, 1, " S ", 0)] + [ok(30 + i, 2, "s", i) for i in range(3)] + [ok(33, 2, "s", 3, 0, 40_000)]
    df = spark.createDataFrame(rows, cols)
    c = compaction.CatalogueCompaction(spark, str(tmp_path / "a")).run(compaction.whole_pieces(df))
    assert sorted(r.file_id for r in c.merges(1).collect()) == ["0", "1", "2", "3", "4"]
    assert [(r.n_inputs, r.n_bytes) for r in c.files().where("level > 0").collect()] == [(5, 44 + 5 * 200)]
    # a run that is repeated finds every level in the journal
    entries = c.entries()
    assert compaction.CatalogueCompaction(spark, str(tmp_path / "a")).run(compaction.whole_pieces(df)).entries() == entries
    assert compaction.CatalogueCompaction(spark, str(tmp_path / "b")).run(compaction.whole_pieces(df.limit(0))).merges().count() == 0


def test_levels_merge_what_lower_levels_wrote(spark, tmp_path):
    tiny = [(1, "s", k, k, 60_000) for k in range(40)] + [(1, "s", 100 + k, 100 + k, 1 << 20) for k in range(3)] + [(2, "s", k, 500 + k, 100_000 + k) for k in range(4)]
    df = spark.createDataFrame(tiny, "record_id bigint, channel string, piece_no bigint, file_id bigint, n_bytes bigint")
    c = compaction.CatalogueCompaction(spark, str(tmp_path / "a"), target_bytes=5 << 20).run(df)
    made = {(r.record_id, r.level): (r.n_inputs, r.first_piece, r.last_piece) for r in c.files().where("level > 0").collect()}
    # 40 tiny files make one of 2.4 MB, the fourth of tier 3, whose 5.4 MB are then cut after it
    assert made == {(1, 1): (40, 0, 39), (2, 2): (4, 0, 3), (1, 4): (3, 100, 102)}
    inputs = [r.file_id for r in c.merges().collect()]
    assert len(inputs) == len(set(inputs)) == 47
    # a level that died half-way is taken up again
    half = compaction.CatalogueCompaction(spark, str(tmp_path / "b"), target_bytes=5 << 20).run(df)
    for n in half.store.names("_journal")[1:]:
        half.store.delete(f"_journal/{n}")
    assert len(half.run(df).entries()) == len(c.entries()) and half.merges().count() == 47


def test_outputs_are_fewer_than_inputs(spark, tmp_path):
    near = spark.createDataFrame([(1, "s", k, k, 1000) for k in range(9)], "record_id bigint, channel string, first_piece bigint, file_id bigint, n_bytes bigint")
    for target in (1001, 1500, 2100, 100_000):
        m = compaction.plan_merges(near, ["record_id", "channel"], ["first_piece"], F.floor(F.col("first_piece") / 2), 4, target)
        outs = m.groupBy("part").count().collect()
        assert all(r["count"] >= 2 for r in outs) and (target == 1001) == (not outs)


def test_compactor_keeps_every_record_once(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(400).repartition(16).write.parquet(path)
    c = compaction.Compactor(spark, path, base=1 << 20)
    assert c.live().count() == 16
    assert c.compact() >= 1 and c.compact() == 0
    assert sorted(r.id for r in c.read().collect()) == list(range(400))
    spark.range(400, 440).repartition(4).write.mode("append").parquet(path)
    c.compact()
    # outputs without a journal entry (a round that died) are not read, and vacuum removes them
    spark.range(5).write.parquet(f"{path}/_merged/lost/data")
    assert sorted(r.id for r in c.read().collect()) == list(range(440))
    assert c.vacuum() > 0
    assert sorted(r.id for r in c.read().collect()) == list(range(440)) and c.live().count() < 4
    empty = compaction.Compactor(spark, str(tmp_path / "e"))
    spark.range(0).write.parquet(str(tmp_path / "e"))
    assert not empty.read().collect()


def test_compactor_of_a_partitioned_folder_in_small_batches(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.range(600).selectExpr("id", "concat('x y', id % 3) k", "if(id % 2 = 0, null, id) v")
    rows.repartition(12).write.partitionBy("k").parquet(path)
    c = compaction.Compactor(spark, path, max_inputs=5)
    before = c.live().count()
    assert c.compact() >= 3 and c.live().count() < before / 4
    assert sorted(map(tuple, c.read().select("id", "k", "v").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    # files just below the target are left as they are, so it ends
    size = c.live().agg(F.max("n_bytes")).first()[0]
    assert compaction.Compactor(spark, path, base=64, target=size + 1).compact() == 0


# ---- p3

FIELDS = ["date", "time", "gain", "temp_c", "ch_s_file", "ch_vs_delay"]
LOG = "rig string, log_seq int, line_no int, line string, arrived_at timestamp_ntz, field string"


def _lines(logs):
    return [(rig, seq, no, line, at(a), "clash") for rig, seq, a, lines in logs for no, line in enumerate(lines)]


LOGS = [
    ("a", 1, 0, ["﻿date\ttime\tGain", "2024-01-02\t10.11.12\t3", None, "", "2024-01-02\t10.11.13", "NA\tnan\t-"]),
    ("a", 3, 0, ["datum;time;\"Gain\" ;temp", "02.01.2024;101112;3,5;", "datum;time;Gain;temp", "2 Jan 2024;36000,4;;\"x\""]),
    ("a", 3, 5, ["datum;time;\"Gain\" ;temp", "02.01.2024;101112;3,5;", "datum;time;Gain;temp", "2 Jan 2024;36000,4;;\"x\""]),
    ("a", 4, 0, ["date|time|temp"]),
    ("a", 9, 0, ["date|time|Gain|temp", "2024/01/02|10h11m12s|7|21 C"]),
    ("b", 1, 0, ["time", "10:11:12"]),
    (None, 1, 0, ["date", "x"]),
]


def test_drift_against_brute_force(spark):
    lines = _lines(LOGS)
    df = spark.createDataFrame(lines, LOG)
    got = sorted(tuple(r)[:4] for r in drift.schema_changes(df, FIELDS, len(lines)).collect())
    want = sorted(brute_drift.changes([x[:5] for x in lines if x[0]], lambda n: drift.field_of(n, set(FIELDS))))
    assert got == want and ("a", 3, "gain", "retyped") in got and ("a", 9, "gain", "added") in got
    assert drift.schema_changes(df.limit(0), FIELDS, 0).count() == 0


def test_drift_table_has_one_type_a_field(spark):
    t = {(r.log_seq, r.line_no): r for r in drift.canonical_table(spark.createDataFrame(_lines(LOGS[:5]), LOG), FIELDS, 40).collect()}
    assert t[1, 1].date == t[3, 1].date == t[3, 3].date == t[9, 1].date == dt.date(2024, 1, 2)
    assert [t[k].time for k in ((1, 1), (3, 1), (3, 3), (9, 1))] == ["10:11:12", "10:11:12", "10:00:00", "10:11:12"]
    assert t[3, 1].gain == 3.5 and t[3, 3].temp_c_text == "x" and t[9, 1].temp_c == 21.0 and t[9, 1].temp_c_text == "21 C"
    assert len(t) == 5


def test_drift_keeps_what_no_field_takes(spark):
    rows = [("a", 1, 0, "date\tcolour\tdatum", at(0)), ("a", 1, 1, "2024-01-02\tred\tother\tmore", at(0)), ("a", 1, 1, "2024-01-01\tblue", at(3)), ("b", 7, 1, "no; header here", at(0)), (None, 1, 1, "lost", at(0)), (None, 1, 1, "lost too", at(0)), ("a", 1, 2, "-\tNA", at(0))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], LOG)
    got = {(r.rig, r.log_seq, r.line_no, r.unknown_text): r for r in drift.canonical_table(df, FIELDS, len(rows)).collect()}
    assert len(got) == 4
    line = next(r for r in got.values() if r.rig == "a")
    assert line.date == dt.date(2024, 1, 2) and line.unknown_text == '[{"name":"colour","value":"red"},{"name":"datum","value":"other"},{"name":"column 4","value":"more"}]'
    assert sorted(k[3] for k in got if k[0] != "a") == ['[{"name":"line","value":"lost too"}]', '[{"name":"line","value":"lost"}]', '[{"name":"line","value":"no; header here"}]']


def test_appearing_alternatives(spark):
    lines = _lines([("a", k, 0, ["gain", *v]) for k, v in enumerate([["-"], ["1"], ["2", "x"], ["3"], ["x", "4,5"], ["5"]])])
    got = drift.appearing_alternatives(spark.createDataFrame(lines, LOG), FIELDS, len(lines)).collect()
    assert sorted(map(tuple, got)) == [("a", 2, "gain", "text"), ("a", 4, "gain", "decimal")]


@pytest.mark.parametrize("name,field", [("wav_chs", "ch_s_file"), ("CH_S_FILE", "ch_s_file"), ("chs_fname", "ch_s_file"), ("vS_dly", "ch_vs_delay"), ("delay_vs", "ch_vs_delay"), ("fecha", "date"), ("what", None), ("", None)])
def test_field_spellings(name, field):
    assert drift.field_of(name, set(FIELDS)) == field


# ---- p4


def test_orphans(spark):
    parents = spark.createDataFrame([(1, at(0), False), (2, at(0), True), (3, at(100), False)], "record_id bigint, first_loaded timestamp_ntz, deleted boolean")
    raw = [(1, 1, at(1)), (2, 1, at(1)), (3, 1, at(1)), (3, 2, at(100)), (3, 3, at(200)), (4, 1, at(900)), (4, 1, at(1)), (None, 1, at(1)), (4, None, at(1)), (4, 2, None)]
    kids = orphans.child_rows(spark.createDataFrame(raw, "record_id bigint, annot_id bigint, loaded_at timestamp_ntz"), "annot_db", "record_id", "annot_id")
    got = sorted((r.record_id, r.row_id, r.reason, r.period) for r in orphans.orphan_rows(parents, kids, 10).collect())
    assert got == [(2, 1, "deleted", "2024-01"), (3, 1, "late", "2024-01"), (4, 1, "missing", "2024-01"), (4, 2, "missing", None)]
    assert orphans.orphan_rows(parents, kids.limit(0), 0).count() == 0
    assert orphans.orphan_rows(parents.limit(0), kids, 10).count() == 7


def test_orphans_of_a_hot_missing_key(spark):
    kids = spark.range(2000).selectExpr("'f' table_name", "if(id % 2 = 0, 5, id) record_id", "id row_id", "timestamp_ntz '2024-05-01 00:00:00' first_loaded")
    parents = spark.createDataFrame([(1, at(0), False)], "record_id bigint, first_loaded timestamp_ntz, deleted boolean")
    assert orphans.orphan_rows(parents, kids, 2000).count() == 1999


# ---- p5


def brute_periods(rows, most):
    out = set()
    by = {}
    for r, s, e in rows:
        by.setdefault(r, []).append((s, e))
    for r, xs in by.items():
        done = []
        for s, e in sorted(xs):
            if done and s <= done[-1][1]:
                done[-1][1] = max(done[-1][1], e)
                done[-1][2] += 1
            else:
                done.append([s, e, 1])
        out |= {(r, "merged", s, e) for s, e, n in done if n > 1}
        out |= {(r, "gap", a[1], b[0]) for a, b in zip(done, done[1:], strict=False) if b[0] - a[1] <= most}
    return out


@pytest.mark.parametrize("seed,span,slot", [(1, 50, 10), (2, 400, 7), (3, 5000, 100), (4, 300, 1000), (5, 2000, 3)])
def test_periods_against_brute_force(spark, seed, span, slot):
    rng = random.Random(seed)
    rows = []
    for r in (1, 1, 1, 2, 3):
        for _ in range(60):
            s = rng.randrange(-20, span)
            rows.append((r, s, s + rng.choice([1, 2, 5, 30, span // 2])))
    df = spark.createDataFrame(rows, "record_id bigint, s bigint, e bigint")
    got = [tuple(x) for x in periods.periods_and_gaps(df, 40, slot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows, 40)
    assert periods.periods_and_gaps(df.limit(0)).count() == 0


def test_interval_map_touching_and_nested():
    m = periods.IntervalMap()
    for s, e in [(10, 20), (30, 40), (20, 30), (12, 13), (50, 60), (45, 50), (0, 100)]:
        m.insert(s, e)
    assert (m.starts, m.ends, m.counts, m.gaps()) == ([0], [100], [7], [])


def test_found_queries_match_sql(spark, data):
    import verify

    assert verify.compare(spark, data, ["p1_found", "p2_found", "p2_outputs", "p4_found", "p4_report", "p5_found"]) == {}


def test_odd_times_and_clashing_columns(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0005,), (-0.0004,), (1e300,)], "s double")
    assert [r[0] for r in df.select(common.to_ms(F.col("s"))).collect()] == [None, None, None, 1001, 0, None]
    rows = spark.createDataFrame([(1, at(1), None, "x", 5)], "k bigint, loaded_at timestamp_ntz, updated_at timestamp_ntz, u string, l int")
    got = common.current_rows(rows, ["k"], {"u": F.col("u"), "l": F.col("l"), "updated_at": F.col("updated_at")}).first()
    assert (got.u, got.l, got.updated_at) == ("x", 5, None)


def test_all_found_queries_on_empty_tables(spark, data, tmp_path):
    import shutil
    from pathlib import Path

    import __spark_entry__ as entry

    for p in Path(data).glob("*.parquet"):
        if p.stem in ("log_field", "run_log", "mix_target", "pack_spec"):
            (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / p.name)
        else:
            spark.read.parquet(str(p)).limit(0).write.parquet(str(tmp_path / p.name))
    for name, f in entry.queries().items():
        if name.startswith(("p1_", "p2_", "p3_", "p4_", "p5_")):
            assert f(spark, str(tmp_path)).count() == 0, name


def test_rows_of_nulls(spark, data, tmp_path):
    import shutil
    from pathlib import Path

    import __spark_entry__ as entry

    for p in Path(data).glob("*.parquet"):
        if p.stem in ("record_db", "file_db", "annot_db", "avimat_log", "record_done", "annot_done"):
            df = spark.read.parquet(str(p))
            empty = spark.createDataFrame([tuple([None] * len(df.columns))] * 3, df.schema)
            df.unionByName(empty).unionByName(df).write.parquet(str(tmp_path / p.name))
        else:
            (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / p.name)
    q = entry.queries()
    for name in ("p1_found", "p2_found", "p3_found", "p4_found", "p5_found"):
        a = sorted(map(tuple, q[name](spark, data).collect()))
        assert sorted(map(tuple, q[name](spark, str(tmp_path)).collect())) == a, name


def test_canonical_table_against_plain_reading(spark, data):
    import __spark_entry__ as entry

    fields = {r.field for r in spark.read.parquet(f"{data}/log_field.parquet").collect()}
    lines = [tuple(r) for r in spark.read.parquet(f"{data}/avimat_log.parquet").select("rig", "log_seq", "line_no", "line", "arrived_at").collect()]
    want = brute_drift.table(lines, lambda n: drift.field_of(n, fields), fields)
    got = {(r.rig, r.log_seq, r.line_no): r for r in entry.queries()["p3_table"](spark, data).collect()}
    assert set(want) <= set(got) and len(want) > 50
    checked = set()
    for k, values in want.items():
        r = got[k]
        for f, v in values.items():
            if f == "time":
                s = brute_drift.seconds(v)
                have = r.time and sum(int(x) * n for x, n in zip(r.time.split(":"), (3600, 60, 1), strict=True))
                assert have == s if s is not None else r.time_text == v, (k, v)
            elif f == "date":
                assert (r.date is not None and (v.isdigit() or str(r.date.year) in v)) or r.date_text == v, (k, v)
            elif f in drift.FILES or f == "operator":
                assert r[f] == v
            else:
                n = brute_drift.number(v)
                assert r[f] == n and (n is not None or r[f"{f}_text"] == v), (k, f, v)
            checked.add(f)
        assert all(r[f] is None and r.asDict().get(f"{f}_text") is None for f in fields - set(values)), k
    assert {"date", "time"} <= checked and len(checked) > 8


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    session = lambda master, folder: N(conf=N(get=lambda *_: folder), sparkContext=N(master=master))
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y/"), "p").startswith("hdfs://x/y/p-")
    assert common.shared_dir(session("local[4]", ""), "p") != common.shared_dir(session("local", ""), "p")
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master, ""))
