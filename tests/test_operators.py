"""Spark operators on small cases: closed forms, edge cases, and invariance to chunks and blocks."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigweave.dataset import Dataset
from sigweave.functions import kernels as K
from sigweave.functions.query import row_predicate, to_sql
from sigweave.operators import catalogue, correlate, ensemble, intervals, longfft, ordered, pipeline, pitch, signals, transforms

KEY = ["rid"]


def samples(spark, *series):
    rows = [(r, i, None if v is None else float(v)) for r, s in enumerate(series) for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "rid bigint, i bigint, v double")


def values(df, order="i"):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.rid, r[order])):
        out.setdefault(r.rid, []).append(r.v)
    return out


def ann(spark, *rows):
    return spark.createDataFrame([(1, k, float(s), float(e)) for k, (s, e) in enumerate(rows)], "rid bigint, annot_id bigint, start double, end double")


# ---- intervals


def test_islands_at_the_edges_and_without_trigger(spark):
    s = samples(spark, [5, 5, 0, 3, 0, 9, 9], [3, 3], [float("nan"), 9, None, 9], [0.0])
    got = sorted(map(tuple, intervals.segment_islands(s, 2, 4).collect()))
    assert got == [(0, 0, 0.0, 2.0, 5.0), (0, 1, 4.0, 7.0, 9.0), (2, 0, 0.0, 2.0, 9.0), (2, 1, 2.0, 4.0, 9.0)]
    assert intervals.segment_islands(s.limit(0), 2, 4).count() == 0


def test_long_island_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(intervals, "CHUNK", 4)
    s = samples(spark, [0.0] * 3 + [5.0] * 20 + [0.0] + [6.0] * 2)
    assert [(r.start, r.end) for r in intervals.segment_islands(s, 1, 4).orderBy("annot_id").collect()] == [(2.0, 23.0), (23.0, 26.0)]


@pytest.mark.parametrize(
    "x,y,both,rest",
    [
        ([(0, 1)], [(1, 2)], [], [(0, 1)]),
        ([(0, 10)], [(2, 3), (5, 6)], [(2, 3), (5, 6)], [(0, 2), (3, 5), (6, 10)]),
        ([(2, 3)], [(0, 10)], [(2, 3)], []),
        ([(0, 10), (1, 9)], [(5, 6)], [(5, 6), (5, 6)], [(0, 5), (1, 5), (6, 9), (6, 10)]),
        ([(0, 200)], [(50, 60), (55, 58), (100, 300)], [(50, 60), (55, 58), (100, 200)], [(0, 50), (60, 100)]),
        ([(0, 5)], [], [], [(0, 5)]),
    ],
)
def test_interval_algebra(spark, x, y, both, rest):
    a, b = ann(spark, *x), ann(spark, *y) if y else ann(spark, (0, 1)).limit(0)
    assert sorted((r.start, r.end) for r in intervals.intersect(a, b).collect()) == sorted(both)
    d = intervals.difference(a, b)
    assert sorted((r.start, r.end) for r in d.collect()) == sorted(rest)
    assert sorted(r.annot_id for r in d.collect()) == list(range(len(rest)))


def test_intersect_against_all_pairs(spark):
    rng = random.Random(4)
    make = lambda n: [(s := rng.uniform(0, 500), s + rng.choice([0.5, 3, 200])) for _ in range(n)]
    x, y = make(40), make(50)
    want = sorted((max(a, c), min(b, d)) for a, b in x for c, d in y if a < d and b > c)
    assert sorted((r.start, r.end) for r in intervals.intersect(ann(spark, *x), ann(spark, *y)).collect()) == want


def test_consolidate_runs_singletons_and_predicates(spark):
    a = ann(spark, (0, 1), (1.1, 2.1), (2.2, 3.2), (8.2, 9.2)).withColumn("comment", F.lit("x")).withColumn("w", F.lit(2))
    got = intervals.consolidate(a, "consolidated_duration / duration > 0.5", ["w"]).orderBy("start").collect()
    assert [(r.start, r.end, r.n, r.comment, r.w) for r in got] == [(0.0, 3.2, 3, "xxx", 6.0), (8.2, 9.2, 1, "x", 2.0)]
    one = ann(spark, (0, 1))
    assert intervals.consolidate(one, "n > 0").count() == 1 and intervals.consolidate(one, "n > 0", drop_singletons=True).count() == 0
    assert intervals.consolidate(a, "n < 0").count() == 4
    with pytest.raises(ValueError):
        row_predicate("__import__('os')")


def test_register_and_duplicates(spark):
    rec = spark.sql("select 1L record_id, timestamp_ntz '2024-01-01 00:00:00' datetime")
    a = spark.createDataFrame([(1, 0, 1.5, 2.0, 7), (1, None, None, None, 8), (9, 0, 1.0, 2.0, 9)], "record_id bigint, annot_id bigint, start double, end double, mark int")
    got = {r.record_id: r for r in intervals.register(a, rec).collect()}
    assert str(got[1].datetime) == "2024-01-01 00:00:01.500000" and got[9].datetime is None and got[1].mark == 7 and got[1].comment == ""
    with pytest.raises(ValueError):
        Dataset(rec).annotate("x", a.unionByName(a))


# ---- signals


def test_crop_pad_clip_reverse(spark):
    s = samples(spark, [1.0, 2, float("nan"), 4])
    assert values(signals.crop(s, KEY, 1.0, 3.0))[0][0] == 2.0
    assert values(signals.pad(s, KEY, 1, 2, 9.0))[0][::5] == [9.0, 9.0] and len(values(signals.pad(s, KEY, 1, 2))[0]) == 7
    c = values(s.withColumn("v", signals.clip(F.col("v"), 1.5, 3.0)))[0]
    assert c[0] == 1.5 and math.isnan(c[2]) and c[3] == 3.0
    assert values(signals.reverse(s, KEY))[0][0] == 4.0
    with pytest.raises(ValueError):
        signals.crop_bounds(F.lit(3), 1.0, 2.0, 1.0, samples=3)


def test_derivative_teager_fir(spark):
    s = samples(spark, [0.0, 1, 4, 9], [5.0])
    assert values(signals.derivative(s, KEY, 2.0)) == {0: [2.0, 4.0, 8.0, 10.0], 1: [None]}
    assert values(signals.teager(s, KEY)) == {0: [1.0, 7.0]}
    assert values(signals.fir(s, KEY, [1.0, 1.0]))[0] == [0.0, 1.0, 5.0, 13.0]


def test_normalize_zero_spread_is_null(spark):
    s = samples(spark, [2.0, 2.0], [-4.0, 2.0])
    assert values(signals.normalize(s, KEY, "meanstd"))[0] == [None, None]
    assert values(signals.normalize(s, KEY))[1] == [-1.0, 0.5]


@pytest.mark.parametrize("tjust", [0.0, 0.5, 1.0])
def test_interpolation_holds_edges(spark, tjust):
    rng = np.random.default_rng(3)
    x = rng.random(9)
    t = np.linspace(-1, 10, 45)
    p = spark.createDataFrame([(0, float(v)) for v in t], "rid bigint, t double")
    got = {r.t: r.v for r in signals.at_times(samples(spark, x.tolist()), p, KEY, tjust=tjust).collect()}
    want = np.where((t >= 0) & (t <= 9), np.interp(t, np.arange(9) + tjust, x), 0)
    assert np.allclose([got[float(v)] for v in t], want)


def test_combine_missing_rules(spark):
    a, b = samples(spark, [1.0, float("nan"), 3.0]), samples(spark, [10.0, float("nan")])
    assert values(signals.combine(a, b, KEY))[0] == [11.0, None, 3.0]
    assert values(signals.combine(a, b, KEY, 0, "-"))[0] == [-9.0, 0.0, 3.0]


def test_bins_like_array_split(spark):
    for n in (5, 7, 23, 100):
        x = np.random.default_rng(n).random(n)
        got = values(signals.bins(samples(spark, x.tolist()), KEY, 7, F.max("v"))).get(0, [])
        assert np.allclose(got, K.bin_map(x, 7, np.max))


def test_sliding_correlation_and_match(spark):
    rng = np.random.default_rng(0)
    tpl = rng.random(20)
    x = np.zeros(400)
    for at in (30, 100, 250):
        x[at : at + 20] = tpl * 3 + 1
    tr = correlate.sliding(samples(spark, x.tolist()), KEY, tpl.tolist())
    hits = transforms.match(tr, KEY, 20, 1.0, 0.99).orderBy("annot_id").collect()
    assert [r.start for r in hits] == [30.0, 100.0, 250.0] and all(r.max_cor == pytest.approx(1) for r in hits)
    want = [np.corrcoef(x[k : k + 20], tpl)[0, 1] for k in range(95, 110)]
    assert np.allclose(values(tr)[0][95:110], want)
    flat = correlate.sliding(samples(spark, [1.0] * 30), KEY, tpl.tolist())
    assert set(values(flat)[0]) == {None} and set(values(correlate.sliding(samples(spark, x.tolist()), KEY, [1.0] * 5))[0]) == {0.0}


def test_blocks_give_what_the_whole_gives(spark):
    x = np.random.default_rng(5).random(3000)
    s = samples(spark, x.tolist())
    whole = K.butter(x, 100.0, high=20.0)
    got = values(transforms.pointwise(s, KEY, lambda v: K.butter(v, 100.0, high=20.0), halo=512, size=700))[0]
    assert np.allclose(got[:-1], whole[:-1], atol=1e-6) and len(got) == 3000
    assert np.allclose(values(transforms.smooth(s, KEY, 7, 3))[0], K.savgol(x, 7, 3))
    f, t, p = K.log_spectrogram(x, 100.0, "scipy", nperseg=64, noverlap=48)
    sp = transforms.spectrogram(s, KEY, 100.0, nperseg=64, noverlap=48).collect()
    assert len(sp) == p.size and all(abs(r.log10_power - p[r.freq_idx, r.seg]) < 1e-9 for r in sp)
    b = ordered.blocks(s, KEY, size=700, halo=10).orderBy("block").collect()
    assert [(r.i0, r.own0, r.own_n, len(r.x)) for r in b] == [(0, 0, 700, 710), (690, 10, 700, 720), (1390, 10, 700, 720), (2090, 10, 700, 720), (2790, 10, 200, 210)]


def test_user_function_errors_are_rows(spark):
    got = transforms.apply(samples(spark, [1.0, 2.0], [3.0]), KEY, lambda x: x * 2 if len(x) > 1 else 1 / 0).collect()
    assert sorted((r.rid, r.i, r.v, r.error) for r in got if r.rid == 0) == [(0, 0, 2.0, None), (0, 1, 4.0, None)]
    assert [(r.i, r.v, r.error) for r in got if r.rid == 1] == [(None, None, "ZeroDivisionError")]
    half = values(transforms.apply(samples(spark, range(10)), KEY, lambda x: x[::2].cumsum()))
    assert half == {0: [0.0, 2.0, 6.0, 12.0, 20.0]}
    local = values(transforms.apply(samples(spark, range(100)), KEY, lambda x: np.convolve(x, [1, 1, 1], "same"), halo=1, size=7))
    assert local[0] == np.convolve(np.arange(100.0), [1, 1, 1], "same").tolist()


LONG = 3 * transforms.BLOCK + 777


@pytest.fixture(scope="module")
def long_signal(spark):
    x = np.sin(np.arange(LONG) ** 1.2 / 50) * (1 + np.arange(LONG) % 977 / 500) + 0.3
    return spark.createDataFrame([(0, x.tolist())], "rid bigint, x array<double>").select("rid", F.posexplode("x").alias("i", "v")).withColumn("i", F.col("i").cast("bigint")).checkpoint(), x


@pytest.mark.parametrize(
    "method,rate,args",
    [
        ("binmax", 44_100.0, {}), ("binmap", 44_100.0, {"func": lambda c: float(c[0] + c[-1]), "repeat": 2}), ("robust", 44_100.0, {"cut_freq": 20.0}), ("teager", 44_100.0, {}), ("robust_teager", 44_100.0, {"percentile": 5}),
        ("log_robust_teager", 44_100.0, {}), ("jarne", 44_100.0, {}), ("jarne", 44_100.0, {"bin_size": 4415, "cut_freq": 4.0}), ("mindlin", 44_100.0, {}), ("absint", 44_100.0, {}),
    ],
)
def test_envelopes_of_a_long_signal(long_signal, method, rate, args):
    s, x = long_signal
    want, r = K.envelope(x, rate, method, **args)
    got = transforms.envelope(s, KEY, rate, method, **args).orderBy("i").toPandas()
    assert got["i"].tolist() == list(range(len(want))) and got["env_rate"].iloc[0] == pytest.approx(r)
    assert np.allclose(got["v"], want, atol=1e-9 * np.nanmax(np.abs(want)), equal_nan=True)


@pytest.mark.parametrize("method", ["scipy", "scipy_praat", "mlab", "mlab_praat"])
def test_spectrograms_of_a_long_signal(long_signal, method):
    s, x = long_signal
    f, t, p = K.log_spectrogram(x, 44_100.0, method)
    got = transforms.spectrogram(s, KEY, 44_100.0, method, delay=2.0).where("freq_idx % 37 = 1").toPandas()
    assert len(got) == p.shape[1] * len(range(1, len(f), 37)) and got["seg"].max() == p.shape[1] - 1
    assert np.allclose(got["log10_power"], p[got["freq_idx"], got["seg"]], atol=1e-6) and np.allclose(got["t"], t[got["seg"]] + 2)


def test_spectrograms_of_array_parts(spark, long_signal):
    _, x = long_signal
    x = x[:150_000]
    cuts = [0, 70_000, 70_001, 131_072, 150_000]
    parts = spark.createDataFrame([(0, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)], "rid bigint, first bigint, samples array<double>")
    for method in ("scipy", "scipy_praat"):
        f, t, p = K.log_spectrogram(x, 44_100.0, method)
        got = transforms.spectrogram(parts, KEY, 44_100.0, method).where("freq_idx % 37 = 1").toPandas()
        assert len(got) == p.shape[1] * len(range(1, len(f), 37)) and np.allclose(got["log10_power"], p[got["freq_idx"], got["seg"]], atol=1e-6)
    got = transforms.spectrogram(parts, KEY, 1000.0, tlim=(60.0, 80.0)).toPandas()
    assert got["seg"].nunique() == (20_000 - 512) // 64 + 1


def test_blocks_of_a_batch_are_handed_on_one_by_one(monkeypatch):
    class Rows:
        dtypes = [("rid", "bigint")]

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(transforms, "shipped", lambda df: df)
    n = transforms.FLUSH // 4
    for out, ddl in ((lambda i0: (np.arange(i0, i0 + n), np.zeros(n)), "i bigint, v double"), (lambda i0: (np.array([i0]), [np.zeros(n)]), "first bigint, samples array<double>")):
        run = transforms._map_blocks(Rows(), KEY, lambda _, i0, own0, own_n, x, out=out: out(i0), ddl)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 10), pa.array([k * n for k in range(10)]), pa.array([0] * 10), pa.array([1] * 10), pa.array([[0.0]] * 10)], names=["rid", "i0", "own0", "own_n", "x"])
        got = list(run([batch]))
        sizes = [rb.num_rows for rb in got]
        assert sizes == ([4 * n, 4 * n, 2 * n] if "v" in ddl.split() else [4, 4, 2])
        assert [k for rb in got for k in rb.column(1).to_pylist()][:: n if "v" in ddl.split() else 1] == [k * n for k in range(10)]


def test_parts_of_rows_number_as_rows_do(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 1]), rng.choice([None, *range(-40, 40)]), rng.choice([None, 0.5, 2.5, float("nan")]), rng.choice([None, -1.5, 0.1, 7.0])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "rid bigint, k int, o double, q double").repartition(5)
    got = ordered.parts_of_rows(df, KEY, ["k", "o"], ["q", "o"], lambda q, o: (10 * q, -o), 2, F.floor(F.col("k") / 16))
    got = [tuple(map(str, r)) for r in ordered.explode_signal(got, KEY).orderBy("rid", "i").collect()]
    want = ordered.number_rows(df, KEY, ["k", "o", "q"], "n", F.floor(F.col("k") / 16), scan=True).orderBy("rid", "n").collect()
    nan = float("nan")
    want = [(str(r.rid), str(2 * r.n + j), str(v)) for r in want for j, v in enumerate((nan if r.q is None else 10 * r.q, nan if r.o is None else -r.o))]
    assert got == want and len(got) == 6000
    one = ordered.parts_of_rows(spark.range(50_000).selectExpr("0L rid", "id k", "id / 4 q"), KEY, ["k"], ["q"], lambda q: (q, -q), 2, F.lit(7))
    assert sorted((r.first, r.n, len(r.samples), r.samples[1]) for r in one.collect()) == [(0, 100_000, 65_536, 0.0), (65_536, 100_000, 34_464, -8192.0)]
    none = ordered.parts_of_rows(df.where("k > 99"), KEY, ["k"], ["q"], lambda q: (q,), 1, F.floor(F.col("k") / 16))
    assert none.count() == 0


def shuffled_mb(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size())) / 1e6


def test_analytic_signals_of_array_parts_shuffle_little(spark):
    """The parts go through one shuffle with small halos; the transform that this replaces sent 64 bytes or more a sample."""
    rng, rows, want = np.random.default_rng(2), [], {}
    for rid, n in enumerate((300_000, 262_145, 65_537, 500)):
        x = rng.standard_normal(n) + 20 * np.sin(np.arange(n) / 3) + 5
        rows += [(rid, a, x[a : a + 70_001].tolist()) for a in range(0, n, 70_001)] + [(rid, 0, [])]
        want[rid] = x
    parts = spark.createDataFrame(rows, "rid bigint, first bigint, samples array<double>").checkpoint()
    was = shuffled_mb(spark)
    got = transforms.hilbert(parts, KEY).checkpoint()
    assert shuffled_mb(spark) - was < 2.5 * 8e-6 * sum(map(len, want.values()))
    assert got.columns == ["rid", "first", "samples"]
    for rid, v in values(ordered.explode_signal(got, KEY)).items():
        exact = K.hilbert_magnitude(want[rid])
        assert len(v) == len(exact) and np.abs(v - exact).max() < 1e-13 * np.abs(exact).max() * 10
    got = transforms.envelope(parts, KEY, 1000.0, "mindlin")
    assert got.columns == ["rid", "first", "samples", "env_rate"]
    got = values(ordered.explode_signal(got, KEY))
    assert all(np.allclose(got[rid], K.envelope(x, 1000.0, "mindlin")[0], rtol=0, atol=1e-11) for rid, x in want.items()) and len(got) == 4


@pytest.mark.parametrize("n", [1000, 1001, 65_538, 131_071])
@pytest.mark.parametrize("before,after", [(0, 0), (700, 30), (40_000, 0)])
def test_boxes_of_an_analytic_signal(n, before, after):
    x = np.random.default_rng(n).standard_normal(n) + np.arange(n) * 30 / n
    c = np.zeros((longfft.boxes(n), 2, longfft.NODES))
    for a in range(0, n, 777):
        low, own = longfft.sums(n, a, x[a : a + 777])
        c[low : low + len(own)] += own
    f, b, out = longfft.far(n, c), longfft.blocks_of(n, before, after), []
    for k, (lo, hi, low, high, s0, s1) in enumerate(zip(*(b[c].tolist() for c in ("lo", "hi", "low", "high", "s0", "s1")), strict=True)):
        assert lo == max(0, s0 - before) and hi == min(n, s1 + after) and longfft.start(n, low) <= lo and longfft.start(n, high + 1) >= hi
        y = longfft.magnitudes(n, low, high, x[np.arange(b["e0"][k], b["e1"][k]) % n], f[low : high + 1])
        exact = K.hilbert_magnitude(x)[longfft.start(n, low) : longfft.start(n, high + 1)]
        assert len(y) == len(exact) and np.abs(y - exact).max() < 1e-12 * np.abs(exact).max()
        out.append((s0, s1))
    assert out[0][0] == 0 and out[-1][1] == n and all(p[1] == q[0] for p, q in zip(out, out[1:], strict=False))


@pytest.mark.parametrize("n", [65_540, 65_541])
def test_a_missing_sample_spreads_over_its_analytic_signal(spark, n):
    rows = [(0, 0, [1.0] * 40_000), (0, 40_000, [2.0] * (n - 40_001) + [None]), (1, 0, [1.0, 2.0] * (n // 2)), (2, 0, [float("inf")] + [0.0] * (n - 1))]
    got = values(ordered.explode_signal(transforms.hilbert(spark.createDataFrame(rows, "rid bigint, first bigint, samples array<double>"), KEY), KEY))
    assert len(got[0]) == n and np.isnan(got[0]).all() and not np.isnan(got[1]).any() and np.isnan(got[2]).all()


def test_chains_of_array_parts(spark):
    x = np.sin(np.arange(5000) / 30) + np.random.default_rng(1).random(5000)
    rng, cuts = random.Random(3), [0]
    while cuts[-1] < 5000:
        cuts.append(min(5000, cuts[-1] + rng.choice([1, 3, 500, 1700])))
    rows = [(0, a, x[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)] + [(1, 0, [1.0, None, 2.0]), (2, 0, [])]
    parts = spark.createDataFrame(rows, "rid bigint, first bigint, samples array<double>")
    for size, halo, after in ((700, 10, 10), (64, 200, 5), (5000, 0, 0), (333, 0, 40)):
        want = ordered.blocks(ordered.explode_signal(parts, KEY), KEY, size=size, halo=halo, after=after).drop("x")
        got = ordered.blocks(parts, KEY, size=size, halo=halo, after=after)
        assert sorted(map(str, got.drop("x").collect())) == sorted(map(str, want.collect())), (size, halo, after)
        assert all(r.x == x[r.i0 : r.i0 + len(r.x)].tolist() for r in got.where("rid = 0").collect())
    y = transforms.integrate(transforms.butter(parts.where("rid = 0"), KEY, 100.0, high=10.0), KEY, 20)
    assert y.columns == ["rid", "first", "samples"]
    assert np.allclose(values(ordered.explode_signal(y, KEY))[0], K.integrator(np.abs(K.butter(x, 100.0, high=10.0)), 20))


def test_filters_of_a_long_signal(long_signal):
    s, x = long_signal
    for kw in ({"high": 5.0}, {"low": 50.0, "high": 400.0}, {"low": 3.0, "causal": True}):
        got = transforms.butter(s, KEY, 44_100.0, **kw).orderBy("i").toPandas()["v"]
        assert np.allclose(got, K.butter(x, 44_100.0, **kw), atol=1e-9), kw
    got = transforms.lfilter(s, KEY, [1.0], [1.0, -1.0]).orderBy("i").toPandas()["v"]
    assert np.allclose(got, np.cumsum(x))
    got = transforms.lfilter(s, KEY, [0.1, 0.2], [1.0, -1.6, 0.65]).orderBy("i").toPandas()["v"]
    assert np.allclose(got, K.lfilter([0.1, 0.2], [1.0, -1.6, 0.65], x))
    got = transforms.decimate(s, KEY, 10).orderBy("i").toPandas()["v"]
    assert np.allclose(got, K.decimate(x, 10), atol=1e-9)
    got = transforms.hilbert(s, KEY).orderBy("i").toPandas()["v"]
    assert np.allclose(got, K.hilbert_magnitude(x), atol=1e-9)


def test_a_cut_too_high_raises_and_short_signals_are_whole(spark):
    s = samples(spark, np.sin(np.arange(300)).tolist(), [1.0])
    with pytest.raises(ValueError):
        transforms.envelope(s, KEY, 100.0, "jarne", bin_size=5)
    _, p = K.welch(np.sin(np.arange(300)), 100.0, 512)
    assert np.allclose([r.power for r in transforms.welch(s, KEY, 100.0).where("rid = 0").orderBy("freq_idx").collect()], p)
    t = transforms.spectrogram(s, KEY, 10.0, tlim=(5.0, 12.0), nperseg=16, noverlap=8).agg(F.min("t"), F.max("t"), F.countDistinct("seg")).first()
    assert tuple(t) == pytest.approx((5.8, 10.6, 7))


def test_correlation_modes_follow_their_definition(spark):
    x, tpl = np.random.default_rng(2).random(30), [1.0, 3.0, 2.0, 5.0]
    s = samples(spark, x.tolist())
    for mode in ("valid", "full", "same"):
        got = values(correlate.sliding(s, KEY, tpl, "pearson_global", mode=mode))[0]
        assert np.allclose(got, np.correlate(x, tpl, mode) / 4), mode
    assert correlate.mode_delay("full", 4, 2.0) == -2.0 and correlate.mode_delay("same", 4, 2.0) == 0.0


def test_records_with_too_many_matches_say_so(spark):
    x = np.tile([0.0, 1.0, 3.0, 1.0, 0.0, 0.5, 0.2, 0.1], 20)
    s = samples(spark, x.tolist(), x[:40].tolist())
    m = pipeline.match(s, "rid", [0.0, 1.0, 3.0, 1.0, 0.0], 1.0, 0.99, max_roi=10).collect()
    assert [(r.rid, r.error) for r in m if r.error] == [(0, "max_roi")] and sorted(r.start for r in m if r.rid == 1) == [0.0, 8.0, 16.0, 24.0, 32.0]
    assert pipeline.match(s, "rid", [0.0, 1.0, 3.0, 1.0, 0.0], 1.0, 0.99, max_roi=None).count() == 25
    own = pipeline.match(s, "rid", lambda x: x[8:13] if len(x) > 100 else x[:0], 1.0, 0.99, max_roi=None).collect()
    assert len([r for r in own if r.rid == 0]) == 20


def test_templates_conform_signals(spark):
    x = np.zeros(400)
    x[100:140], x[300:340] = np.hanning(40) * 5, np.hanning(40) * 2
    s = samples(spark, x.tolist())
    env, r = K.envelope(x, 100.0, "binmax", bin_size=4)
    hits = pipeline.match(s, "rid", pipeline.Template(env[25:35].tolist(), r, "env", "binmax", {"bin_size": 4}), 100.0, 0.95).orderBy("start").collect()
    assert [round(h.start, 2) for h in hits] == [1.0, 3.0]
    with pytest.raises(ValueError):
        pipeline.conform(s, KEY, 100.0, pipeline.Template([1.0], 50.0))


def test_spectrogram_match_against_brute_force(spark):
    rng = np.random.default_rng(8)
    p, q = rng.random((20, 5)), rng.random((3, 5))
    spec = spark.createDataFrame([(0, s, f, float(p[s, f])) for s in range(20) for f in range(5)], "rid bigint, seg bigint, f bigint, p double")
    tpl = spark.createDataFrame([(s + 7, f, float(q[s, f])) for s in range(3) for f in range(5)], "seg bigint, f bigint, q double")
    got = [r.r for r in correlate.spectrogram_match(spec, tpl, KEY).orderBy("seg").collect()]
    assert np.allclose(got, [np.corrcoef(p[k : k + 3].ravel(), q.ravel())[0, 1] for k in range(18)])


def test_consolidate_in_parts(spark):
    rng = random.Random(2)
    rows, t = [], 0.0
    for k in range(200):
        t += rng.choice([0.1, 0.5, 30.0])
        rows.append((k % 2, k, t, t + 1.0))
        t += 1.0
    a = spark.createDataFrame(rows, "rid bigint, annot_id bigint, start double, end double")
    rule = "consolidated_duration / duration > 0.3 and duration < 20"
    whole, parts = intervals.consolidate(a, rule), intervals.consolidate(a, rule, max_gap=20.0)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    single = a.where("annot_id in (0, 1, 3)")
    assert intervals.consolidate(single, rule, drop_singletons=True, max_gap=1.0).select("rid").distinct().collect()[0].rid == 1


def test_warp_summary_text_is_read_again(spark):
    x = np.sin(np.arange(300) / 15)
    pairs = spark.createDataFrame([(1, i, float(x[i]), float(np.sin((i - 3) / 15))) for i in range(300)] + [(2, 0, 1.0, 1.0)], "rid bigint, i bigint, x double, y double")
    knots = transforms.stw(pairs, KEY, 1000.0)
    s = transforms.warp_summary(knots, KEY).collect()
    assert [r.rid for r in s] == [1] and len(s[0].times) == len(s[0].delays) == 4 and s[0].min_delay <= s[0].max_delay and s[0].cor > 0.99
    assert knots.where("rid = 2").first().error
    w = transforms.warped(pairs.where("rid = 1").selectExpr("rid", "i", "x v"), KEY, 1000.0, s[0].text).orderBy("i").collect()
    assert np.nanmax(np.abs(np.array([r.v for r in w], float) - np.sin((np.arange(300) - 3) / 15))[20:-20]) < 0.1


# ---- hot keys and positions


def test_last_before_over_chunks(spark):
    rng = random.Random(1)
    left = [(k % 3, k, rng.uniform(0, 50)) for k in range(300)]
    right = [(k % 3, rng.uniform(0, 50), k) for k in range(100)]
    a, b = spark.createDataFrame(left, "k int, id int, t double"), spark.createDataFrame(right, "k int, t double, v int")
    got = {r.id: r.v for r in pipeline.last_before(a, b, ["k"], "t", "v", F.floor(F.col("t") / 3)).collect()}
    assert got == {i: max(((t2, v) for k2, t2, v in right if k2 == k and t2 <= t), default=(0, None))[1] for k, i, t in left}


def test_numbers_over_all_rows(spark):
    df = spark.range(1000).selectExpr("concat('same prefix ', lpad(id * 7919 % 1000, 4, '0')) s", "id")
    got = ordered.number_all(df, ["s"], "n", 5).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.s)] == list(range(5, 1005))
    assert ordered.number_all(df.limit(0), ["s"], "n").count() == 0


def test_record_positions(spark):
    df = spark.createDataFrame([(k,) for k in (5, 1, 9, 3)], "record_id bigint")
    assert [[r.record_id for r in pipeline.record_at(df, p).collect()] for p in (0, 2, -1, 4, -5)] == [[1], [5], [9], [], []]


def test_columns_by_functions(spark):
    rec = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "record_id bigint, rig string")
    d = Dataset(rec).transform("records", name=(lambda r: r["rig"].upper(), "string")).transform("records", by=["rig"], n="count(*)")
    assert sorted((r.record_id, r["name"], r.n) for r in d.records.collect() if r.rig) == [(1, "A", 2), (3, "A", 2)]
    assert d.records.where("record_id = 2").first()["name"] is None


# ---- ensembles


def test_ensemble_statistics_ignore_nan(spark):
    e = spark.createDataFrame([(1, 0, 1.0), (2, 0, 3.0), (3, 0, float("nan")), (1, 1, 0.0), (2, 1, 0.0)], "rid bigint, k bigint, v double")
    r = {x.k: x for x in ensemble.statistics(e).collect()}
    assert (r[0]["mean"], r[0]["median"], r[0]["std"]) == (2.0, 2.0, 1.0) and math.isnan(r[0]["average"]) and r[1]["cv"] is None


def test_hstack_crossfade_weights(spark):
    a = spark.createDataFrame([(1, [0.0] * 6)], "rid bigint, values array<double>")
    b = spark.createDataFrame([(1, [1.0] * 6), (2, [1.0])], "rid bigint, values array<double>")
    assert ensemble.hstack(a, b, KEY, 4).collect()[0]["values"] == [0, 0, 0.25, 0.4375, 0.625, 0.8125, 1, 1]


def test_dejitter_recovers_shifts(spark):
    base = np.exp(-((np.arange(40) - 20) ** 2) / 8.0)
    rows = [(r, k, float(np.roll(base, s)[k])) for r, s in enumerate([0, 0, 0, 2, -1]) for k in range(40)]
    got = ensemble.dejitter(spark.createDataFrame(rows, "rid bigint, k bigint, v double"), KEY, 4, 3)
    out = {r.rid: r.k for r in got.groupBy("rid").agg(F.max_by("k", "v").alias("k")).collect()}
    assert set(out.values()) == {20}


def test_samples_of_rows(spark):
    d = spark.range(20).toDF("a")
    assert ensemble.sample(d, 5, 1, order=["a"]).count() == 5 and ensemble.sample(d, 50, 1).count() == 20
    b = ensemble.sample(d, 60, 1, True, ["a"]).collect()
    assert len(b) == 60 and {r.a for r in b} <= set(range(20))


def test_silence_between_syllables(spark):
    p = spark.createDataFrame([(1, "a", 0.0, 500.0), (1, "a", 0.1, 500.0), (1, "b", 0.15, 600.0)], "rid bigint, syl string, time double, freq double")
    fill = sorted(round(r.time, 4) for r in pitch.silence_fill(p, KEY).where("freq = 0").collect())
    assert fill == [round(0.1 + 0.005 * k, 4) for k in range(1, 10)]


# ---- catalogue and queries


def test_catalogue_checks(spark):
    ch = spark.createDataFrame([(1, "s", "a", 0.0), (2, "s", "b", None)], "record_id bigint, channel string, file string, delay double")
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "known_file string, new_file string")
    with pytest.raises(ValueError):
        catalogue.register_channel(ch, twice, "s", "n")
    with pytest.raises(ValueError):
        catalogue.register_channel(ch, twice.limit(1), "s", "n", files=spark.createDataFrame([("q",)], "file string"))
    assert catalogue.register_channel(ch, twice.limit(1), "s", "n").where("channel = 'n'").count() == 1
    files = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "file_id bigint, file string, size int")
    new = spark.createDataFrame([("b", 5), ("c", 6)], "file string, size int")
    assert sorted((r.file_id, r.file, r.size) for r in catalogue.add_files(files, new).collect()) == [(0, "a", 1), (1, "b", 5), (2, "c", 6)]
    with pytest.raises(ValueError):
        catalogue.add_files(files, new.unionByName(new))
    assert spark.range(1).select(catalogue.record_id(F.lit("2024-01-02"), F.lit("03.04.05"))).first()[0] == 20240102030405


@pytest.mark.parametrize("q,n", [("a == 1", 1), ("(a > 0) & ~(b == 'x')", 1), ("1 <= a < 3 and b in ['x', 'y']", 2), ("a in @ks", 1), ("b != 'x' or a == 1", 3)])
def test_query_strings(spark, q, n):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (0, "z")], "a int, b string")
    assert df.where(to_sql(q, {"ks": [2, 7]})).count() == n


def test_dataset_methods(spark):
    rec = spark.createDataFrame([(1, None), (2, None), (3, None)], "record_id bigint, datetime timestamp_ntz")
    a = spark.createDataFrame([(1, 0, 0.0, 4.0), (2, 0, 1.0, 2.0)], "record_id bigint, annot_id bigint, start double, end double")
    d = Dataset(rec, annotations={}).annotate("a", a).annotate("b", a.withColumn("start", F.col("start") + 1))
    assert d.subset("start > 0.5", by="a").records.count() == 1
    assert d.remaining("a").count() == 1 and d.sample(2).records.count() == 2
    assert d.intersect("a", "b", "c").annotations["c"].count() == 1
    assert [(r.start, r.end) for r in d.difference("a", "b", "e").annotations["e"].orderBy("start").collect()] == [(0.0, 1.0), (1.0, 2.0)]
    assert d.get_annotation("a", 1, 0, (1.0, 1.0)).first().start == -1.0
    with pytest.raises(ValueError):
        d.get_annotation("a", annot_id=0)


def test_channels_of_an_annotation(spark):
    rec = spark.createDataFrame([(1,), (2,)], "record_id bigint")
    rows = [(1, c, i, float(i), r) for c, n, r in (("s", 10, 1.0), ("x", 20, 2.0), ("late", 3, 1.0)) for i in range(n)]
    s = spark.createDataFrame(rows, "record_id bigint, channel string, i bigint, v double, rate double")
    ch = spark.createDataFrame([(1, "s", None), (1, "x", 1.0), (1, "late", 50.0)], "record_id bigint, channel string, delay double")
    a = spark.createDataFrame([(1, 0, 2.0, 4.0), (2, 0, 0.0, 9.0)], "record_id bigint, annot_id bigint, start double, end double")
    got = Dataset(rec, ch, samples=s, annotations={"a": a}).annotation_signals("a", 1)
    assert sorted((r.channel, r.i) for r in got.collect()) == [("s", 2), ("s", 3), ("x", 2), ("x", 3), ("x", 4), ("x", 5)]
    with pytest.raises(ValueError):
        catalogue.r_frame(spark.range(1).select(F.array("id").alias("a")))


def test_iteration_over_annotations(spark):
    rec = spark.createDataFrame([(1,), (2,)], "record_id bigint")
    s = samples(spark, [], [5.0, 6.0, 7.0, 8.0], [9.0]).withColumnRenamed("rid", "record_id")
    a = spark.createDataFrame([(1, 1, 1.0, 3.0), (1, 0, 0.0, 1.0), (2, 0, 5.0, 6.0)], "record_id bigint, annot_id bigint, start double, end double")
    d = Dataset(rec, samples=s, annotations={"a": a})
    assert [(r.record_id, r.annot_id, r.samples) for r in d.iterate("a")] == [(1, 0, [5.0]), (1, 1, [6.0, 7.0]), (2, 0, [])]
    assert [r.samples for r in d.iterate("a", flanking=(0.0, 1.0))][:2] == [[5.0, 6.0], [6.0, 7.0, 8.0]]


def test_segments_across_blocks(spark):
    n = transforms.BLOCK * 2 + 700
    x = np.sin(np.arange(n) ** 1.5 / 300)
    s = spark.range(n).selectExpr("0L rid", "id i", "sin(pow(id, 1.5D) / 300) v")
    f, p = K.welch(x, 100.0, 500)
    got = sorted(transforms.welch(s, KEY, 100.0, 500).collect(), key=lambda r: r.freq_idx)
    assert np.allclose([r.power for r in got], p, rtol=1e-6)
    f, t, p = K.log_spectrogram(x, 100.0, "mlab", nfft=96, noverlap=64)
    got = transforms.spectrogram(s, KEY, 100.0, "mlab", nfft=96, noverlap=64).where("freq_idx = 3").orderBy("seg").collect()
    assert [r.seg for r in got] == list(range(p.shape[1]))
    assert np.allclose([r.t for r in got], t) and np.allclose([r.log10_power for r in got], p[3], atol=1e-4)
