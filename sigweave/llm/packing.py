"""Vector bin packing: texts into containers under simultaneous limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one container at a time: of the items that fit, the one whose demand, weighted by how
scarce each dimension is, has the greatest dot product with what is left. Items are dealt by hash to shards of bounded
size that pack in parallel; containers left too empty are dissolved and their items packed again, together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import checkpointed, shipped

SHARD_ITEMS = 4096
MAX_SEGMENTS = 64
LOSS_SHARE = 0.9
DISSOLVE_BELOW = 0.98


def place(tokens: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: float) -> np.ndarray:
    """Container number of each item. An item over the loss limit by itself gets a container without others of its kind.

    Limits bind as soon as a container holds an item; an item alone is bound by its tokens only.
    """
    n = len(tokens)
    out = np.full(n, -1, np.int64)
    order = np.lexsort((np.arange(n), -loss, -tokens))
    t, l = tokens[order].astype(float), loss[order].astype(float)
    # scarcity: the share of the limit that all items ask for
    wt, wl, ws = t.sum() / capacity, l.sum() / max(max_loss, 1.0), n / max_segments
    total = max(wt + wl + ws, 1e-12)
    at, al = wt / total / capacity**2, wl / total / max(max_loss, 1.0) ** 2
    alive, box = np.arange(n), 0
    while len(alive):
        rt, rl, rs = capacity, max_loss, max_segments
        first = True
        while rs and len(alive):
            x, y = t[alive], l[alive]
            if first:
                k = 0  # the largest item left opens the container
            else:
                # sorted by tokens: everything that fits by tokens is a suffix
                s = int(np.searchsorted(-x, -rt))
                if s == len(x):
                    break
                score = at * rt * x[s:] + al * rl * y[s:]
                score[y[s:] > rl] = -1.0
                j = int(np.argmax(score))
                if score[j] < 0:
                    break
                k = s + j
            out[order[alive[k]]] = box
            rt -= x[k]
            rl -= y[k]
            rs -= 1
            alive = np.delete(alive, k)
            first = False
        box += 1
    return out


def pieces(items: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """pack_name, capacity, doc_id, piece_no, start_token, n_tokens, loss_tokens, whole.

    Only a text longer than the capacity is cut, into full containers and a rest. Texts without tokens have no piece.
    """
    specs = F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in sorted(capacities.items())])
    each = items.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", "loss_tokens", F.explode(specs).alias("p")).select("p.*", "doc_id", F.col("n_tokens").alias("all"), F.col("loss_tokens").alias("all_loss"))
    cut = each.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(all - 1) div capacity"))).alias("piece_no"))
    cut = cut.withColumn("start_token", F.col("piece_no") * F.col("capacity")).withColumn("n_tokens", F.least(F.col("capacity"), F.col("all") - F.col("start_token")))
    upto = lambda x: F.expr(f"all_loss * ({x}) div all")
    return cut.withColumn("loss_tokens", upto("start_token + n_tokens") - upto("start_token")).select("pack_name", "capacity", "doc_id", "piece_no", "start_token", "n_tokens", "loss_tokens")


_PLACED = "pack_name string, capacity bigint, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint, loss_tokens bigint, container string, fill double"


def _round(items: DataFrame, tag: str, counts: dict[str, int], max_segments: int, loss_share: float) -> DataFrame:
    shards = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-c // SHARD_ITEMS))])
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(tag), "doc_id", "piece_no"), F.try_element_at(shards, F.col("pack_name"))).cast("bigint"))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        pdf = pdf.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
        box = place(pdf["n_tokens"].to_numpy(), pdf["loss_tokens"].to_numpy(), capacity, max_segments, loss_share * capacity)
        used = np.bincount(box, weights=pdf["n_tokens"].to_numpy())
        pdf["container"] = [f"{tag}-{key[1]:06d}-{b:05d}" for b in box]
        pdf["fill"] = used[box] / capacity
        return pdf.drop(columns="shard")

    return shipped(dealt).groupBy("pack_name", "shard").applyInPandas(pack, _PLACED)


def pack_texts(items: DataFrame, capacities: dict[str, int], max_segments: int = MAX_SEGMENTS, loss_share: float = LOSS_SHARE) -> DataFrame:
    """Every token of every text in exactly one container of each capacity.

    items: doc_id (unique), n_tokens, loss_tokens. capacities: a fixed, small table of names and tokens. Result:
    pack_name, capacity, container, doc_id, piece_no, start_token, n_tokens, loss_tokens. Ties go by doc_id, so the same
    input gives the same containers. Empty input or texts without tokens give no row.
    """
    cut = checkpointed(pieces(items, capacities))
    full = cut.where(F.col("n_tokens") == F.col("capacity"))
    part = cut.where(F.col("n_tokens") < F.col("capacity"))
    count = lambda df: {r[0]: r[1] for r in df.groupBy("pack_name").count().collect()}
    n1 = count(part)
    out = full.withColumn("container", F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")))
    cols = ["pack_name", "capacity", "container", "doc_id", "piece_no", "start_token", "n_tokens", "loss_tokens"]
    out = out.select(*cols)
    if n1:
        first = checkpointed(_round(part, "a", n1, max_segments, loss_share))
        out = out.unionByName(first.where(F.col("fill") >= DISSOLVE_BELOW).select(*cols))
        loose = first.where(F.col("fill") < DISSOLVE_BELOW).drop("container", "fill")
        n2 = count(loose)
        if n2:
            out = out.unionByName(_round(loose, "b", n2, max_segments, loss_share).select(*cols))
    return out


def pack_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the least possible number of containers, unused share, most segments in one."""
    boxes = packed.groupBy("pack_name", "capacity", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("segments"))
    return boxes.groupBy("pack_name", "capacity").agg(
        F.count("*").alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        F.expr("cast(ceil(sum(used) / any_value(capacity)) as bigint)").alias("least_containers"),
        (1 - F.sum("used") / F.sum("capacity")).alias("unused_share"),
        F.max("segments").alias("most_segments"),
    )
