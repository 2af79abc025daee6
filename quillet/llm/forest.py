"""Embedding near-duplicates by a random-projection tree forest.

Trees are fitted on a bounded sample: each node splits at the median of a random projection, and vectors near the split
go down both sides. Every vector is then sent down every tree, vectors are compared within leaves only, in double
precision, and what reaches the cosine is linked and united.

Exact copies are compared once and counted by their number. A pair that meets in several leaves counts in the first
only. A leaf with more than ``block`` vectors is compared in pairs of blocks, so no task holds a whole large leaf.

Vectors of different lengths link with nothing of each other; each length has trees of its own. Vectors that are null,
empty, zero or hold null or non-finite components link with nothing. Rows that repeat an id are vectors of their own,
linked as copies; of equal ids the component's is the least. A null id is nobody's component. Only ``vec_id`` and
``embedding`` are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import components, pick
from quillet.session import cut

COSINE = 0.95
#: What a fit looks at, at most; how large leaves should be; trees.
SAMPLE, LEAF, TREES = 16_384, 256, 6
BLOCK = 1024
#: More than a tree has leaves; leaves are numbered by the vectors' length, the tree and the leaf.
NODES = 1 << 24


@lru_cache(maxsize=4096)
def _direction(seed: int, width: int) -> np.ndarray:
    """A node's direction; a number stands for it wherever the tree is sent."""
    d = np.random.default_rng(seed).standard_normal(width)
    return d / np.linalg.norm(d)


@dataclass(frozen=True)
class Tree:
    """Node 0 is the root; ``left`` and ``right`` are nodes, or leaves as -1 - leaf. Directions are made from ``seeds``."""

    seeds: np.ndarray
    cuts: np.ndarray
    left: np.ndarray
    right: np.ndarray
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row of unit vectors comes to."""
        if not len(self.cuts):
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, out_rows, out_leaves = {0: np.arange(len(x))}, [], []
        while rows:
            node, own = rows.popitem()
            side = x[own] @ _direction(int(self.seeds[node]), x.shape[1]) - self.cuts[node]
            for child, mine in ((self.left[node], own[side <= self.margin]), (self.right[node], own[side >= -self.margin])):
                if child < 0:
                    out_rows.append(mine)
                    out_leaves.append(np.full(len(mine), -1 - child))
                elif len(mine):
                    rows[child] = mine
        return np.concatenate(out_rows), np.concatenate(out_leaves)


def grow(sample: np.ndarray, most: float, margin: float, seed: int) -> Tree:
    seeds, cuts, left, right, n_leaves, tried = [], [], [], [], 0, 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(sample)), -1, 0)]
    while todo:
        own, parent, side = todo.pop()
        best = None
        if len(own) > max(most, 4):
            for _ in range(4):  # a split that most rows escape both ways, as within one tight group, is no use
                own_seed, tried = (seed << 32) + tried, tried + 1
                at = sample[own] @ _direction(own_seed, sample.shape[1])
                cut_at = float(np.median(at))
                sides = own[at <= cut_at + margin], own[at >= cut_at - margin]
                if max(map(len, sides)) <= 0.8 * len(own):
                    best = own_seed, cut_at, sides
                    break
        if best is None:
            here, n_leaves = -1 - n_leaves, n_leaves + 1
        else:
            here = len(cuts)
            seeds.append(best[0])
            cuts.append(best[1])
            left.append(0)
            right.append(0)
            todo += [(best[2][0], here, 0), (best[2][1], here, 1)]
        if parent >= 0:
            (left if side == 0 else right)[parent] = here
    return Tree(np.array(seeds, np.int64), np.array(cuts), np.array(left), np.array(right), margin)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _scaled(column: pd.Series) -> np.ndarray:
    """Rows as doubles, each scaled by a power of two, which is exact, so that no norm overflows."""
    x = np.stack(column.to_numpy()).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def fit(vectors: DataFrame, n: int, cosine: float, trees: int, leaf: int, sample: int, seed: int) -> dict[int, list[Tree]]:
    """Trees for each length of vector, on about ``sample`` vectors at most in all, drawn by a hash; leaves are sized for
    all ``n``. A length that isn't drawn has no trees."""
    drawn = vectors.select("vec")
    if n > sample:
        drawn = drawn.where(F.pmod(F.xxhash64(F.lit(seed), "vec"), F.lit(1 << 30)) < int(0.95 * sample / n * (1 << 30)))
    rows = drawn.toPandas()["vec"]
    forests = {}
    for width, own in rows.groupby(rows.map(len)):
        x = unit(_scaled(own))
        margin = 0.5 * np.sqrt(2 * (1 - cosine) / width)  # a half of how far a linked pair's projections usually differ
        forests[int(width)] = [grow(x, leaf * len(rows) / n, margin, seed * 1000 + t) for t in range(trees)]
    return forests


#: One leaf for all vectors of a length.
WHOLE = Tree(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), 0.0)


def _labels(linked: np.ndarray) -> np.ndarray:
    """Components of a small graph given as a matrix: the least index reachable."""
    label = np.arange(len(linked))
    while True:
        seen = np.where(linked, label[None, :], len(linked)).min(axis=1)
        new = np.minimum(label, seen)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def compare(f: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links of one leaf, or of one pair of its blocks: weighted counts, and a tie of each vector to one of its component."""
    f = f.sort_values("uid", ignore_index=True)
    x = _scaled(f["vec"])
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
    np.fill_diagonal(linked, False)
    here, block = int(f["leaf"].iloc[0]), f["block"].to_numpy()
    if f["one"].iloc[0] != f["two"].iloc[0]:
        linked &= block[:, None] != block[None, :]
    label = _labels(linked)
    busy = np.flatnonzero(linked.any(axis=1))
    count = np.zeros(len(f), np.int64)
    if len(busy):
        path = [p[p < here] for p in f["path"].iloc[busy]]
        earlier = np.unique(np.concatenate(path))
        first = linked[np.ix_(busy, busy)].copy()
        if len(earlier):
            met = np.zeros((len(busy), len(earlier)), np.float32)
            for i, p in enumerate(path):
                met[i, np.searchsorted(earlier, p)] = 1
            first &= met @ met.T < 0.5  # they haven't met in a leaf before
        count[busy] = first.astype(np.float64) @ f["n"].to_numpy(np.float64)[busy]
    uid = f["uid"].to_numpy()
    keep = busy
    return pd.DataFrame({"uid": uid[keep], "links": count[keep], "tie": uid[label[keep]]})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    rows = pick(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").alias("vec"))
    fine = F.col("vec").isNotNull() & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("vec", lambda v: v != 0)
    rows = rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("vec")).alias("vec"))
    distinct = cut(rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("uid", F.monotonically_increasing_id()))
    n = distinct.count()
    forests = fit(distinct, n, cosine, trees, leaf, sample, seed)

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, f in frame.groupby(frame["vec"].map(len)):
                x = unit(_scaled(f["vec"]))
                found = [t.leaves(x) for t in forests.get(int(width), [WHOLE])]
                at = np.concatenate([r for r, _ in found])
                to = np.concatenate([k + (int(width) * trees + i) * NODES for i, (_, k) in enumerate(found)])
                order = np.lexsort((to, at))
                at, to = at[order], to[order]
                ends = np.cumsum(np.bincount(at, minlength=len(f)))
                paths = np.split(to, ends[:-1])
                out = f[["uid", "n", "vec"]].iloc[at].reset_index(drop=True)
                out["leaf"], out["path"] = to, [paths[i] for i in at]
                yield out

    kind = distinct.schema["vec"].dataType.simpleString()
    sent = distinct.select("uid", "n", "vec").mapInPandas(route, f"uid long, n long, vec {kind}, leaf long, path array<long>")
    large = distinct.select("uid", "n", "vec").mapInPandas(lambda fs: (g[["leaf"]] for g in route(fs)), "leaf long").groupBy("leaf").count().where(F.col("count") > block)
    large = large.select("leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # a leaf beyond the block goes to cells of two blocks each; every pair of its vectors shares exactly one such cell
    spread = sent.join(large, "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    cells = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    compared = cut(cells.groupBy("leaf", "one", "two").applyInPandas(lambda f: compare(f, cosine), "uid long, links long, tie long"))
    counts = compared.groupBy("uid").agg(F.sum("links").alias("links"))
    united = components(compared.where("uid <> tie").select(F.col("uid").alias("a"), F.col("tie").alias("b")))
    known = distinct.join(counts, "uid", "left").join(united, distinct["uid"] == united["node"], "left").select("vec", "rep", "n", "links", F.coalesce("component", "uid").alias("class"))
    known = cut(known)
    least = known.groupBy("class").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "class").select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "vec", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
