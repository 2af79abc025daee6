from collections import defaultdict

import pytest

from quillet.llm import mixing
from quillet.llm.queries import QUERIES
from tests.llm import data


def fill(sizes, weights=(5, 2, 1), most=3):
    """Share, cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= over
    return target


def check(rows, want_sizes):
    totals, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        totals[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    goal = fill(totals)
    longest = defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], r.size)
        assert r.source_size == totals[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
    for s in totals:
        assert abs(taken[s] - goal[s]) <= 2 * longest[s] + 1
    assert sorted((r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted(x for x in want_sizes if x[0] is not None)


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    want = [(r[0], len((r[1] or "").split())) for r in data.rows()]
    check(mixing.mix(make(spark)).collect(), want)
    again = [sorted(map(str, mixing.mix(make(spark)).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_caps_and_hot_ties(spark):
    rows = [(i, "one two three", "en", "hot", 0) for i in range(600)] + [(1000 + i, "w " * (i + 1), "en", "a", 0) for i in range(9)] + [(2000, None, "en", "zero", 0)]
    check(mixing.mix(spark.createDataFrame(rows, data.DOCS)).collect(), [(r[0], len((r[1] or "").split())) for r in rows])


def test_empty_tables(spark):
    assert mixing.mix(data.empty(spark)).count() == 0
    none = spark.createDataFrame([(1, None, None, None, None)], data.DOCS)
    assert [tuple(r) for r in mixing.mix(none).select("size", "target", "taken").collect()] == [(0, 0.0, 0)]


def test_emit(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = mixing.emit(df)
    assert out.columns == df.columns
    assert out.count() == mixing.mix(df).agg({"copies": "sum"}).first()[0]


@pytest.mark.parametrize("make", [data.docs, data.odd, data.empty])
def test_emit_by_row(spark, make):
    """Equal rows, repeated and null ids: as many rows as are taken, and no column lost."""
    df = make(spark)
    df = df.union(df.where("doc_id = 2")).union(df.where("doc_id = 2")).union(df.where("doc_id is null"))
    out = mixing.emit(df)
    taken, rows = mixing.mix(df).collect(), out.collect()
    assert out.columns == df.columns and len(rows) == sum(r.copies for r in taken)
    each = defaultdict(int)
    for r in taken:
        each[r.doc_id] += r.copies
    assert {i: sum(r.doc_id == i for r in rows) for i in each} == each


def test_query(spark):
    rows = QUERIES["op3_mixing"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken"]
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(mixing.mix(df).collect(), [(r.doc_id, len(r.text.split())) for r in df.collect()])
