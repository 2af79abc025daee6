import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import forest
from quillet.llm.queries import QUERIES


def brute(ids, vectors, cosine=0.95):
    """Links by all pairs, then the smallest id reachable."""
    ok = [i for i, v in enumerate(vectors) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    x = np.array([vectors[i] for i in ok], float).reshape(len(ok), -1)
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / np.outer(norm, norm) >= cosine
    np.fill_diagonal(linked, False)
    label = [ids[i] for i in ok]
    changed = True
    while changed:
        changed = False
        for i in range(len(ok)):
            low = min([label[i], *[label[j] for j in np.flatnonzero(linked[i])]])
            changed |= low < label[i]
            label[i] = low
    out = {i: (0, i) for i in ids}
    out |= {ids[i]: (int(linked[k].sum()), label[k]) for k, i in enumerate(ok)}
    return out


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def test_edges(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 1.0], 0), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0), (8, [1.0, None], 0), (9, [float("inf"), 1.0], 0), (10, [], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1e300, 1e290], 0), (13, [-1.0, 0.0], 0)]
    df = frame(spark, rows, "double")
    for made in (df, df.select("*", F.lit(1).alias("uid"), F.lit(2).alias("n"), F.lit(3).alias("vec"))):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(made).collect()}
        want = {i: (0, i, True) for i in range(1, 14)}
        want |= {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 12: (3, 1, False)}
        assert got == want
    assert forest.near_duplicates(df.limit(0)).count() == 0
    again = forest.near_duplicates(df.union(df.where("vec_id = 4"))).where("vec_id = 4").collect()
    assert [r.n_links for r in again] == [1, 1]
    alone = frame(spark, [(1, None, 0)])
    assert [tuple(r) for r in forest.near_duplicates(alone).collect()] == [(1, 0, 1, True)]


def test_lengths(spark):
    """Vectors of every length are compared among their own, few or many, with trees fitted on them or none."""
    rng = np.random.default_rng(4)
    x = [v.tolist() for d, n in ((2, 3), (3, 2), (8, 300), (16, 500)) for v in np.concatenate([rng.standard_normal((n, d)), np.repeat(rng.standard_normal((1, d)), 3, axis=0)])]
    for sample in (forest.SAMPLE, 100):
        got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(frame(spark, [(i, v, 0) for i, v in enumerate(x)]), leaf=50, sample=sample).collect()}
        want = {}
        for d in (2, 3, 8, 16):
            own = [i for i, v in enumerate(x) if len(v) == d]
            want |= brute(own, [np.float32(x[i]).tolist() for i in own])
        assert got == want


@pytest.mark.parametrize("block, sample", [(40, forest.SAMPLE), (1000, forest.SAMPLE), (1000, 400)])
def test_groups(spark, block, sample):
    """Tight groups of all sizes, larger than leaves and blocks, give brute force's links and components."""
    rng = np.random.default_rng(0)
    parts = [rng.standard_normal((900, 16))]
    for n in (2, 5, 60, 300):
        parts.append(rng.standard_normal((1, 16)) + 0.12 * rng.standard_normal((n, 16)))
    parts.append(np.repeat(rng.standard_normal((1, 16)), 50, axis=0))
    x = np.concatenate(parts).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(x))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_duplicates(frame(spark, [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]), leaf=50, block=block, sample=sample).collect()}
    want = brute(ids, x.tolist())
    links = sum(n for n, _ in want.values())
    found = sum(n for n, _ in got.values())
    assert all(got[i][0] <= want[i][0] for i in ids) and found >= 0.97 * links
    assert np.mean([got[i][1] == want[i][1] for i in ids]) >= 0.99


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    data = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([r.vec_id for r in data], [r.embedding for r in data])
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op10_embeddings"](spark, sf).collect()}
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
