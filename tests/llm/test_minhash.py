import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import common, links, minhash
from quillet.llm.queries import QUERIES
from tests.llm import data


def weights(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def brute(rows, least=0.8):
    label = {i: i for i, _ in rows}
    bags = {i: weights(t) for i, t in rows}
    find = lambda i: i if label[i] == i else find(label[i])
    at = {}
    for i, t in rows:
        for g in bags[i]:
            at.setdefault(g, []).append(i)
    pairs = {(x, y) for ids in at.values() for x in ids for y in ids if x < y}
    for x, y in pairs:
        if similarity(bags[x], bags[y]) >= least:
            a, b = sorted((find(x), find(y)))
            label[b] = a
    return {i: find(i) for i in label}


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(50)]
    for share in (0.1, 0.3, 0.6):
        a = [r.choice(vocabulary) for _ in range(400)]
        b = [r.choice(vocabulary) if r.random() < share / 5 else w for w in a]
        texts = [" ".join(x).encode() for x in (a, b)]
        s, _ = minhash.darts(*minhash.multisets(texts), 2, 4096)
        assert abs((s[0] == s[1]).mean() - similarity(weights(texts[0].decode()), weights(texts[1].decode()))) < 0.04
    key = np.arange(40, dtype=np.uint64)
    halves = np.concatenate([np.full(40, 1.0), np.full(40, 0.5)])  # real weights: similarity one half
    s, _ = minhash.darts(common.mixed(np.tile(key, 2)), np.repeat([0, 1], 40), halves, 2, 4096)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.04


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(make(spark)).collect()), key=str)
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    near = similarity(weights(data.EN), weights(data.EN + " and more")) >= 0.8
    rows = [(r[0], 1 if r[0] is None and near else want.get(r[0])) for r in data.rows()]
    assert got == sorted(((i, c, i == c) for i, c in rows), key=str)
    assert minhash.keep(make(spark)).columns == make(spark).columns


def test_empty(spark):
    assert minhash.near_duplicates(data.empty(spark)).count() == 0
    assert minhash.keep(data.empty(spark)).count() == 0


def test_keep_by_row(spark):
    """Null and repeated ids: clean rows stay beside the copies, and one row of each class."""
    base = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    rows = [(1, base["a"]), (None, base["a"] + " x"), (None, base["b"]), (2, base["c"]), (2, base["a"] + " y"), (None, base["d"]), (None, base["d"] + " z"), (3, base["e"]), (3, base["e"]), (4, base["f"]), (3, base["f"]), (None, None), (None, "")]
    kept = [(r.doc_id, r.text) for r in minhash.keep(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.DOCS)).collect()]
    want = [(1, base["a"]), (None, base["b"]), (2, base["c"]), (3, base["e"]), (3, base["f"]), (None, None), (None, "")]
    named = [x for x in kept if x[1] not in (base["d"], base["d"] + " z")]
    assert sorted(named, key=str) == sorted(want, key=str) and len(kept) == len(named) + 1


def edited(words, n, r):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"edit{r.random()}"
    return out


def test_groups_of_near_copies(spark):
    """Large groups around a middle, chains, shared passages: brute force's classes."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    passage = [word() for _ in range(60)]
    for size in (2, 3, 80):
        middle = [word() for _ in range(200)]
        texts += [" ".join(edited(middle, r.randint(1, 6), r)) for _ in range(size)]
    for _ in range(120):
        texts.append(" ".join([word() for _ in range(50)] + passage))
    chain = [word() for _ in range(200)]
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 3, r)
    texts += ["same text here"] * 30 + ["a b c d e f g"] * 3 + ["a b c d e f g h"]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.DOCS)).collect()}
    assert got == brute(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + j) for i in range(6) for j in range(6)] + [(5, 5)]
    r.shuffle(edges)
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 150)}, **{i: 200 for i in range(200, 206)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_compare_all_that_differ(spark):
    """Points on a line in a few buckets: links are of length 1 at most, so leaders alone can't find them all."""
    points = [(i, float(x)) for i, x in enumerate([0, 0.9, 1.8, 2.7, 5, 5.5, 9, 9.9, 20, 20.5, 21])]
    spots = spark.createDataFrame(points, "item long, x double")
    members = spots.select("item", F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(3)).cast("array<long>").alias("bands"))

    def verify(pairs):
        a, b = spots.select(F.col("item").alias("a"), F.col("x").alias("xa")), spots.select(F.col("item").alias("b"), F.col("x").alias("xb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", F.abs(F.col("xa") - F.col("xb")).alias("d"))

    got = {r.node: r.component for r in links.classes(members, verify, 1.0, None, None).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8}


@pytest.mark.parametrize("many", [0, 6, 10**6])
def test_classes_of_pairs_that_share_one_large_bucket(spark, monkeypatch, many):
    """All members share one band and no second one; groups around different middles, some of which share a second
    passage, so leaders settle few."""
    monkeypatch.setattr(links, "MANY", many)
    r = random.Random(5)
    sets, passage, second = [], list(range(1000, 1060)), list(range(3000, 3050))
    for g in range(12):
        middle = [*passage, *range(g * 100, g * 100 + 60), *(second if g % 2 else [])]
        for _ in range(5):
            sets.append(set(middle) - set(r.sample(middle, r.randint(0, 12))) | {r.randrange(10**6, 10**9) for _ in range(r.randint(0, 12))})
    held = spark.createDataFrame(list(enumerate(map(list, sets))), "item long, tokens array<long>")
    members = held.select("item", F.array(F.lit(-1), F.col("item")).cast("array<long>").alias("bands"))

    def both(pairs, a, b):
        x, y = held.select(F.col("item").alias(a), F.col("tokens").alias("ta")), held.select(F.col("item").alias(b), F.col("tokens").alias("tb"))
        return pairs.join(x, a).join(y, b)

    def verify(pairs):
        return both(pairs, "a", "b").select("a", "b", (1 - F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("d"))

    def firsts(pairs, common):
        late = F.array(*map(F.lit, common)).cast("array<long>")
        lacked, had = F.array_except("tb", "ta"), F.array_intersect("tb", "ta")
        ranked = F.concat(*[F.sort_array(x) for x in (F.array_except(lacked, late), F.array_except(had, late))], F.array_intersect(late, "tb"))
        return both(pairs, "lead", "item").select("lead", "item", F.size("tb").alias("size"), F.slice(ranked, F.lit(1), links.room(F.size("tb"), 0.8)).alias("tokens"))

    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    want = {frozenset(i for i, x in enumerate(label) if x == c) for c in label if label.count(c) > 1}
    got = {}
    for x in links.classes(members, verify, 0.2 + 1e-12, lambda wanted: held.join(wanted, "item"), firsts).collect():
        got.setdefault(x.component, set()).add(x.node)
    assert len(want) > 5 and set(map(frozenset, got.values())) == want


@pytest.mark.parametrize("large", [64, 3])
def test_buckets_are_led_in_one_pass(spark, monkeypatch, large):
    """Large buckets, known by a sample, are led by a join; all others are neither counted first nor found again."""
    monkeypatch.setattr(links, "SAMPLE", 1)
    monkeypatch.setattr(links, "LARGE", large)
    r = random.Random(11)
    rows = [(i, b) for i in range(300) for b in {r.randrange(200), 1000 + i, *([7000] if i % 3 else []), *([8000] if i > 290 else [])}]
    buckets = {}
    for i, b in rows:
        buckets.setdefault(b, []).append(i)
    out = links._first_led(spark.createDataFrame(rows, "item long, bucket long"))
    assert sorted((x.bucket, x.item, x.lead, x.apart, x.pos, x.size) for x in out.collect()) == sorted((b, i, min(own), i != min(own), None, None) for b, own in buckets.items() if len(own) > 1 for i in own)
    ran = []
    monkeypatch.setattr(links, "cut", lambda df: ran.append(df) or df)
    few = spark.createDataFrame(rows, "item long, bucket long").where("bucket < 200 and item < 100")
    monkeypatch.setattr(links, "LARGE", 64)
    plan = links._first_led(few)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(ran) == 2


def test_members_of_several_large_buckets_are_split_once(spark, monkeypatch):
    """Buckets of one component have leaders of their own, but one order of tokens, so no member's tokens are taken twice."""
    monkeypatch.setattr(links, "MANY", 0)
    r = random.Random(7)
    middle = list(range(200))
    sets = [set(middle) - set(r.sample(middle, n)) | {r.randrange(10**6, 10**9) for _ in range(n)} for n in [r.randint(1, 8) for _ in range(30)] + [r.randint(40, 60) for _ in range(10)]]
    held = spark.createDataFrame(list(enumerate(map(list, sets))), "item long, tokens array<long>")
    spots = [(i, [k for k in range(6) if r.random() < 0.6] + [100 + i]) for i in range(40)]
    split = []

    def both(pairs, a, b):
        x, y = held.select(F.col("item").alias(a), F.col("tokens").alias("ta")), held.select(F.col("item").alias(b), F.col("tokens").alias("tb"))
        return pairs.join(x, a).join(y, b)

    def verify(pairs):
        return both(pairs, "a", "b").select("a", "b", (1 - F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("d"))

    def firsts(pairs, common):
        split.extend(x.item for x in pairs.collect())
        ranked = F.concat(F.sort_array(F.array_except("tb", "ta")), F.sort_array(F.array_intersect("tb", "ta")))
        return both(pairs, "lead", "item").select("lead", "item", F.size("tb").alias("size"), F.slice(ranked, F.lit(1), links.room(F.size("tb"), 0.8)).alias("tokens"))

    monkeypatch.setattr(links, "_common", lambda held: [])
    got = {x.node: x.component for x in links.classes(spark.createDataFrame(spots, "item long, bands array<long>"), verify, 0.2 + 1e-12, lambda wanted: held.join(wanted, "item"), firsts).collect()}
    assert set(got) == set(range(30)) and len(set(got.values())) == 1
    assert len(split) >= 30 and len(split) == len(set(split))


def test_marks_leave_out_far_pairs_only(spark):
    """Of pairs in one bucket only those that the marks let be near are made, and none that is near is left out. The
    marks of both operators say so."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    middle = [word() for _ in range(300)]
    own = [" ".join(edited(middle, r.randint(1, 40), r)).encode() for _ in range(60)]
    held, ends = minhash.tokens(own)
    sets = [set(x.tolist()) for x in np.split(held, ends[:-1])]
    sizes, flat = minhash.marks(own)
    python = spark.createDataFrame([(i, int(n), x) for i, (n, x) in enumerate(zip(sizes, flat.tolist(), strict=True))], "item long, weight int, mark array<long>")
    native = spark.createDataFrame([(i, x) for i, own in enumerate(sets) for x in own], "item long, token long").groupBy("item").agg(*links.mark())
    rows = python.select("item", F.lit(1).alias("bucket"), F.col("item").alias("class"), F.lit(-1).alias("main"), F.lit(None).cast("long").alias("lead"), F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("size"))
    near = {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    close = {(i, j) for j in range(60) for i in range(j) if len(sets[i] & sets[j]) >= 0.65 * len(sets[i] | sets[j])}
    assert len(near) > 20 and len(close) < 900
    every = python.select(F.col("item").alias("a")).crossJoin(python.select(F.col("item").alias("b"))).where("a < b")
    for marks in (python, native):
        for pairs in (links._direct(rows, 0.2 + 1e-12, marks), links._unmarked(every, marks, 0.2 + 1e-12)):
            got = {(x.a, x.b) for x in pairs.collect()}
            assert near <= got and len(got - close) < 20


def test_marks_tell_large_sets_apart(spark):
    """Sets of 2000 tokens of which 1200 differ: with 512 places half of them differ at most, fewer than may."""
    rows = [(i, t) for i in (0, 1) for t in [*range(800), *range(10_000 * (i + 1), 10_000 * (i + 1) + 1200)]] + [(2, t) for t in [*range(800), *range(10_000, 11_190)]]
    marks = spark.createDataFrame(rows, "item long, t long").select("item", F.xxhash64("t").alias("token")).groupBy("item").agg(*links.mark())
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert [(x.a, x.b) for x in links._unmarked(pairs, marks, 0.2 + 1e-12).collect()] == [(0, 2)]


def test_a_compared_leader_keeps_no_bucket_open(spark):
    """Buckets of two, and those whose members beside the leader are in one component, are done."""
    buckets = {1: [0, 5], 2: [0, 6, 7], 3: [0, 5, 6]}
    held = spark.createDataFrame([(b, i, 0, None, None, i > 0) for b, own in buckets.items() for i in own], "bucket long, item long, lead long, pos int, size int, apart boolean")
    seen = spark.createDataFrame([(0, 5, 0.9), (0, 6, 0.5)], "a long, b long, d double")
    found = spark.createDataFrame([(6, 6), (7, 6)], "node long, component long")
    for bounded in (False, True):
        got = links._open(held, seen, found, 0.2, bounded).collect()
        assert sorted((x.bucket, x.item, x.d) for x in got) == [(3, 5, 0.9), (3, 6, 0.5)]


def test_first_tokens():
    """Near multisets share one of the first tokens."""
    r = random.Random(4)
    for _ in range(40):
        words = [r.choice("abcdefgh") for _ in range(60)]
        own = [" ".join(edited(words, r.randint(0, 2), r)).encode() for _ in range(2)]
        lead = " ".join(r.choice("abcdefgh") for _ in range(60)).encode()
        sizes, lists = minhash.first_tokens([lead, lead], own, np.unique(minhash.tokens(own)[0])[::-7], 0.8)
        a, b = (set(x) for x in lists.to_pylist())
        assert sizes.to_pylist() == [56, 56] and all(len(x) == 56 - 45 + 1 for x in (a, b))
        assert similarity(*(weights(x.decode()) for x in own)) < 0.8 or a & b


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in QUERIES["op2_minhash"](spark, sf).collect()} == brute(rows)
