"""Mixing: shares, repeats, shortages to siblings first."""

import numpy as np
import pytest

from sigweave.llm import mixing

SCHEMA = "doc_id bigint, lang string, source string, n_tokens bigint"


def docs(spark, spec, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for lang, source, n in spec:
        for _ in range(n):
            rows.append((k, lang, source, int(rng.integers(1, 200))))
            k += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_shares_are_met_and_repeats_kept(spark):
    d = docs(spark, [("en", "a", 800), ("EN", " A ", 200), ("de", "b", 300), ("ger", "c", 60), (None, "c", 5), ("en", "other", 50), ("en", None, 50)])
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.15, 8), "none": (0.05, 3)}
    m = mixing.mix(d, targets)
    rep = {r.source: r for r in mixing.mix_report(m, targets).collect()}
    for s, (w, k) in targets.items():
        if s != "none":
            assert rep[s].actual_share == pytest.approx(w / 0.95, abs=0.02) and rep[s].most_uses <= k
    assert rep["none"].used_tokens == 0 and sum(r.actual_share for r in rep.values()) == pytest.approx(1)
    assert {r.source for r in m.select("source").distinct().collect()} == {"a", "b", "c"}
    again = mixing.mix(d, targets)
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, m.collect())) != sorted(map(tuple, mixing.mix(d, targets, seed=1).collect()))


def test_prefix_is_of_whole_epochs_first(spark):
    d = docs(spark, [("en", "a", 50), ("en", "b", 50)])
    uses = {r.uses for r in mixing.mix(d, {"a": (0.9, 3), "b": (0.1, 1)}).where("source = 'a'").collect()}
    assert uses in ({2, 3}, {3}, {2})


def test_shortage_goes_to_siblings_before_ancestors():
    leaves = [("d", "en", "a", 100), ("d", "en", "b", 1000), ("d", "de", "a", 1000), ("d", "de", "b", 1000)]
    root = mixing.Node("all")
    for w, (dom, lang, s, n) in zip((0.4, 0.1, 0.25, 0.25), leaves, strict=True):
        leaf = root.child(dom).child(lang).child(s)
        leaf.weight, leaf.capacity = w, n
    root.settle()
    root.allot(1000)
    en, de = root.children["d"].children["en"], root.children["d"].children["de"]
    assert en.children["a"].budget == 100 and en.children["b"].budget == 400 and de.budget == 500
    root.allot(3000)
    assert en.budget == 1100 and de.budget == 1900
    root.allot(9999)
    assert root.budget == 3100


def test_nothing_to_mix(spark):
    d = docs(spark, [("en", "x", 3)])
    assert mixing.mix(d, {"a": (1.0, 1)}).count() == 0
    assert mixing.mix(d.limit(0), {"a": (1.0, 1)}).count() == 0
    rep = mixing.mix_report(mixing.mix(d, {"a": (1.0, 1)}), {"a": (1.0, 1)}).first()
    assert rep.used_tokens == 0 and rep.actual_share == 0


def test_languages(spark):
    d = spark.createDataFrame([("eng",), ("zh-Hans",), ("es-419",), (None,), (" DE ",), ("klingon",)], "l string")
    assert [r[0] for r in d.select(mixing.language_of(d.l)).collect()] == ["en", "zh", "es", "und", "de", "und"]


def test_nothing_that_fits_is_left_over(spark):
    d = docs(spark, [("en", "a", 300), ("de", "a", 200), ("en", "b", 5)])
    targets = {"a": (0.8, 1), "b": (0.2, 1)}
    m = mixing.mix(d, targets).collect()
    leaves: dict = {}
    for r in m:
        leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
    share = mixing.budgets([(*k, sum(r.n_tokens for r in v)) for k, v in leaves.items()], targets)
    for k, v in leaves.items():
        left = share[k] - sum(r.n_tokens * r.uses for r in v)
        free = [r.n_tokens for r in v if r.uses < targets[k[2]][1]]
        assert left >= -1e-6 and (not free or left < min(free))


def test_each_epoch_has_its_own_order(spark):
    d = docs(spark, [("en", "a", 200)])
    tokens = sum(r.n_tokens for r in d.collect())
    extra = [{r.doc_id for r in mixing.mix(d, {"a": (1.0, 3)}, total=tokens * (e + 0.5)).collect() if r.uses == e + 1} for e in (0, 1)]
    assert all(40 < len(x) < 160 for x in extra) and extra[0] != extra[1]


def test_shortages_in_the_tree_report(spark):
    rows = [(k, lang, s, 10, dom) for k, (dom, lang, s) in enumerate([("x", "en", "a")] * 10 + [("x", "en", "b")] * 90 + [("x", "de", "a")] * 100 + [("y", "en", "b")] * 100)]
    d = spark.createDataFrame(rows, SCHEMA + ", domain string")
    targets = {"a": (0.6, 1), "b": (0.4, 1)}
    m = mixing.mix(d, targets, relative=0.9)
    rep = {(r.domain, r.lang, r.source): r for r in mixing.tree_report(m, targets, relative=0.9).collect()}
    leaf, sibling, root = rep["x", "en", "a"], rep["x", "en", "b"], rep[None, None, None]
    assert root.used_tokens == 2700 == root.budget and leaf.budget == leaf.capacity == 100 == leaf.used_tokens
    assert sibling.budget >= sibling.asked and sum(r.budget for k, r in rep.items() if k[2]) == pytest.approx(2700)
    assert {r.level for r in rep.values()} == {"all", "domain", "lang", "source"}
