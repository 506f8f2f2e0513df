"""Sources mixed to target weights by hierarchical budgeting.

Weights go down a tree domain - language - source. A leaf that cannot use its budget (its tokens times the repeats
allowed) leaves the rest to its siblings first; only what a whole branch cannot use goes to the branch's siblings. Each
leaf then takes full epochs of its documents and, of the next one, the token-prefix in a seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..operators.common import checkpointed

#: Language codes of three letters and their two-letter form.
CODES = {"eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "chi": "zh", "zho": "zh", "rus": "ru", "jpn": "ja", "hin": "hi", "ara": "ar", "tha": "th"}
PREFIX_BUCKETS = 4096


@dataclass
class Node:
    """A branch or leaf of the budget tree: weight among its siblings, capacity in tokens (of leaves), budget; asked is what
    the weights alone would give it of its parent's budget."""

    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, "Node"] = field(default_factory=dict)
    budget: float = 0.0
    asked: float = 0.0

    def child(self, name: str) -> "Node":
        return self.children.setdefault(name, Node(name))

    def settle(self) -> None:
        """Sums weights and capacities upwards."""
        for c in self.children.values():
            c.settle()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())

    def allot(self, budget: float) -> None:
        """Gives budget to the children by weight; what one cannot use goes to its siblings by their weights."""
        self.budget = min(budget, self.capacity)
        if not self.children:
            return
        for c in self.children.values():
            c.asked = self.budget * c.weight / self.weight if self.weight > 0 else 0.0
        left, open_ = self.budget, [c for c in self.children.values() if c.capacity > 0]
        given = {c.name: 0.0 for c in self.children.values()}
        while open_ and left > 1e-9 * max(1.0, self.budget):
            total = sum(c.weight for c in open_)
            share = {c.name: left * (c.weight / total if total > 0 else 1 / len(open_)) for c in open_}
            full = [c for c in open_ if given[c.name] + share[c.name] >= c.capacity]
            if not full:
                for c in open_:
                    given[c.name] += share[c.name]
                break
            for c in full:
                left -= c.capacity - given[c.name]
                given[c.name] = c.capacity
            open_ = [c for c in open_ if c not in full]
        for c in self.children.values():
            c.allot(given[c.name])


def language_of(lang):
    """Code of a language of two or three letters however spelled (at most 26**2 + 26**3); 'und' if it is none."""
    base = F.split(F.lower(F.btrim(lang)), "[-_]")[0]
    short = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), base), base)
    return F.when(short.rlike("^[a-z]{2,3}$"), short).otherwise("und")


def budget_tree(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float | None = None, relative: float | None = None) -> Node:
    """The tree domain - language - source with its budgets.

    leaves: their tokens. targets: share and greatest number of uses by source. A source's weight is spread over its
    leaves by their tokens; of a source without any it stands, with no capacity, in every language, so that its share
    falls to its siblings there. relative: total as a multiple of all tokens at hand. Both None: the most at which every
    source that has tokens keeps its share.
    """
    have: dict[str, float] = {}
    branch: dict[tuple[str, str], float] = {}
    for d, g, s, n in leaves:
        have[s] = have.get(s, 0.0) + n
        branch[d, g] = branch.get((d, g), 0.0) + n
    everything = sum(branch.values())
    root = Node("all")
    for d, g, s, n in leaves:
        leaf = root.child(d).child(g).child(s)
        leaf.weight = targets[s][0] * n / have[s] if have[s] else 0.0
        leaf.capacity = float(n * targets[s][1])
    for s, (w, _) in targets.items():
        if not have.get(s):
            for (d, g), n in branch.items():
                root.child(d).child(g).child(s).weight = w * n / everything if everything else 0.0
    root.settle()
    if relative is not None:
        total = relative * everything
    if total is None:
        live = {s: w for s, (w, _) in targets.items() if have.get(s) and w > 0}
        total = min((have[s] * targets[s][1] / (w / sum(live.values())) for s, w in live.items()), default=0.0)
    root.asked = total
    root.allot(total)
    return root


def leaves_of(root: Node) -> dict[tuple[str, str, str], Node]:
    return {(d.name, g.name, s.name): s for d in root.children.values() for g in d.children.values() for s in g.children.values()}


def budgets(leaves: list[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]], total: float | None = None, relative: float | None = None) -> dict[tuple[str, str, str], float]:
    """Token budget of each leaf (domain, language, source)."""
    return {k: n.budget for k, n in leaves_of(budget_tree(leaves, targets, total, relative)).items()}


KEY = ["domain", "lang", "source"]


def mix(items: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, seed: int = 0, relative: float | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, uses: how often the mixture takes each document (0 left out).

    items: doc_id (unique), lang, source, n_tokens, domain optional. Sources compare without case and outer blanks; those
    not in targets, NULL ones and texts without tokens are not used. Leaves are at most domains x languages x targets, so
    their sums are a small table for the driver. A leaf takes whole epochs and, of the next, the token-prefix in that
    epoch's own seeded order, found by hash buckets: bucket sums first (at most PREFIX_BUCKETS a leaf), then single
    documents of the one bucket that the budget ends in, so no leaf is sorted whole. The prefix ends before a document too
    long for what is left; rounds over the documents after it follow until none that is free fits any more.
    """
    if "domain" not in items.columns:
        items = items.withColumn("domain", F.lit("all"))
    clean = items.select("doc_id", F.coalesce("domain", F.lit("none")).alias("domain"), language_of(F.col("lang")).alias("lang"), F.lower(F.btrim("source", F.lit(" \t\r\n"))).alias("source"), "n_tokens")
    clean = clean.where((F.col("n_tokens") > 0) & F.col("source").isin(list(targets)))
    sums = clean.groupBy(*KEY).agg(F.sum("n_tokens").alias("n")).collect()
    share = budgets([(r.domain, r.lang, r.source, r.n) for r in sums], targets, total, relative)
    spark = items.sparkSession
    plan = {(r.domain, r.lang, r.source): _epochs(share[r.domain, r.lang, r.source], r.n, targets[r.source][1]) for r in sums}
    left = {k: rest for k, (_, rest) in plan.items()}
    table = spark.createDataFrame([(*k, e) for k, (e, _) in plan.items()], "domain string, lang string, source string, epochs bigint")
    chosen = clean.join(F.broadcast(table), KEY).withColumn("_h", F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))).withColumn("picked", F.lit(False))
    chosen = chosen.withColumn("_b", F.shiftrightunsigned("_h", 64 - PREFIX_BUCKETS.bit_length() + 1))
    unfilled = any(left.values())
    while unfilled:  # each round takes a document at least of each leaf where one fits
        table = spark.createDataFrame([(*k, n) for k, n in left.items()], "domain string, lang string, source string, rest bigint")
        chosen = checkpointed(_prefix(chosen.join(F.broadcast(table), KEY), KEY))
        now = chosen.groupBy(*KEY).agg(F.sum(F.when(F.col("picked"), F.col("n_tokens")).otherwise(0)).alias("n"), F.min(F.when(~F.col("picked"), F.col("n_tokens"))).alias("least")).collect()
        left = {(r.domain, r.lang, r.source): plan[r.domain, r.lang, r.source][1] - r.n for r in now}
        unfilled = any(r.least is not None and r.least <= left[r.domain, r.lang, r.source] for r in now)
    return chosen.select("doc_id", *KEY, "n_tokens", (F.col("epochs") + F.col("picked").cast("bigint")).alias("uses"))


def _prefix(docs: DataFrame, key: list[str]) -> DataFrame:
    """docs with picked also set for the token-prefix, up to rest tokens, of each leaf's free documents that fit."""
    free = ~F.col("picked") & (F.col("n_tokens") <= F.col("rest"))
    size = F.when(free, F.col("n_tokens")).otherwise(0)
    up = W.partitionBy(*key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = docs.groupBy(*key, "_b").agg(F.sum(size).alias("_in")).withColumn("_base", F.coalesce(F.sum("_in").over(up), F.lit(0)))
    placed = docs.join(buckets, [*key, "_b"])
    edge = (F.col("_base") < F.col("rest")) & (F.col("_base") + F.col("_in") > F.col("rest"))
    w = W.partitionBy(*key, "_b", F.when(~edge, F.col("doc_id"))).orderBy("_h", "doc_id")
    upto = F.col("_base") + F.when(edge, F.sum(size).over(w)).otherwise(F.col("_in"))
    return placed.withColumn("picked", F.col("picked") | (free & (upto <= F.col("rest")))).select(*[c for c in docs.columns if c != "rest"])


def _epochs(budget: float, n: int, most: int) -> tuple[int, int]:
    e = min(int(budget // n), most)
    return e, (0 if e >= most else int(budget - e * n))


def mix_report(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Per source of targets: target_share, max_repeat, available and used tokens, actual_share, documents and most uses."""
    spark = mixed.sparkSession
    asked = spark.createDataFrame([(s, float(w), int(k)) for s, (w, k) in targets.items()], "source string, target_share double, max_repeat int")
    got = mixed.groupBy("source").agg(
        F.sum("n_tokens").alias("available_tokens"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count(F.when(F.col("uses") > 0, 1)).alias("n_docs"), F.max("uses").alias("most_uses")
    )
    j = asked.join(got, "source", "left").fillna(0, ["available_tokens", "used_tokens", "n_docs", "most_uses"])
    every = F.sum("used_tokens").over(W.partitionBy())
    return j.select("*", F.coalesce(F.try_divide(F.col("used_tokens"), every), F.lit(0.0)).alias("actual_share"))


def tree_report(mixed: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, relative: float | None = None) -> DataFrame:
    """Each node of the budget tree: level, domain, lang, source, capacity, asked (by weight), budget, used tokens.

    budget above asked is what siblings could not use; a branch whose budget is below what it asked gave to its own
    siblings. Sums by leaf are the only rows that reach the driver.
    """
    sums = mixed.groupBy(*KEY).agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("uses")).alias("used")).collect()
    used = {(r.domain, r.lang, r.source): int(r.used) for r in sums}
    root = budget_tree([(r.domain, r.lang, r.source, r.n) for r in sums], targets, total, relative)
    rows = []

    def walk(node: Node, path: tuple[str, ...]) -> int:
        at = len(rows)
        rows.append(None)
        n = sum(walk(c, (*path, c.name)) for c in node.children.values()) if node.children else used.get(path, 0)
        rows[at] = (("all", "domain", "lang", "source")[len(path)], *path, *[None] * (3 - len(path)), node.capacity, node.asked, node.budget, n)
        return n

    walk(root, ())
    return mixed.sparkSession.createDataFrame(rows, "level string, domain string, lang string, source string, capacity double, asked double, budget double, used_tokens bigint")
