import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest

from quillet.llm import substrings
from quillet.llm.queries import QUERIES
from tests.llm import data


def brute(rows, n=50):
    out, seen = [], {}
    key = lambda i: -(10**30) if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1):
            w = b[k : k + n]
            seen[w] = min(seen.get(w, key(i)), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1):
            if seen[b[k : k + n]] < key(i):
                gone[k : k + n] = True
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    assert got(substrings.dedup(make(spark))) == brute([(r[0], r[1]) for r in data.rows()])


def test_shared_passages(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abc é") for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 80, 400)] + ["ab" * 60, "a" * 200]
    texts = []
    for _ in range(120):
        parts = [word(r.randint(0, 60)) for _ in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.randint(0, 20)
            parts.insert(r.randint(0, len(parts)), p[cut:] if r.random() < 0.5 else p)
        texts.append("".join(parts))
    texts += texts[:20] + [None, "", "a" * 49, "a" * 50, "a" * 51]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.DOCS)
    assert got(substrings.dedup(df)) == brute(rows)


def test_different_texts_under_one_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (2, b + a), (None, c), (None, d), (3, c + b), (3, d), (3, d), (4, "x" + d + "y"), (4, c[:20])]
    assert got(substrings.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.DOCS))) == brute(rows)


def test_short_periods(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdef") for _ in range(n))
    pairs = [word(n) for n in (1, 2, 7, 16, 17, 29, 34, 35, 36, 60)]
    rows = [(i, word(r.randint(0, 90)) + r.choice(pairs) * r.randint(1, 40) + word(r.randint(0, 90)) + r.choice(pairs) * r.randint(1, 12)) for i in range(80)]
    rows += [(200, pairs[2] * 30), (201, pairs[2] * 30 + "x"), (202, pairs[2][3:] + pairs[2] * 20)]
    assert got(substrings.dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], data.DOCS))) == brute(rows)


def test_repeated_pair_is_one_occurrence():
    """A word pair written thousands of times gave its one anchor, and so one task, that many contexts."""
    text = b"start " * 3 + b"copper lantern " * 5000 + b"the end of it all, and no more of it than this line here says"
    at, h = substrings.anchors(text)
    first, _, last = substrings.joined(text, at, h)
    assert len(at) > 4500
    assert len(first) < 30
    assert set(first.tolist()) | set(last.tolist()) <= set(at.tolist())
    assert (last - first).max() > 70000


def test_memory_of_contexts():
    """A group of occurrences takes some hundred bytes for each, where matrices of hashes took thousands."""
    n = 20000
    numbers = np.stack([np.full(n, 5), np.arange(n), np.zeros(n), np.full(n, 100), np.zeros(n), np.full(n, substrings.REACH), np.full(n, substrings.LENGTH)]).astype("<i8")
    contexts = np.random.default_rng(1).integers(0, 256, (n, substrings.CONTEXT), dtype=np.uint8)
    contexts[n // 2 :] = contexts[: n // 2]
    f = pd.DataFrame({"bucket": [0], "packed": [zlib.compress(numbers.tobytes() + contexts.tobytes(), 1)]})
    tracemalloc.start()
    out = substrings.earlier(f)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["doc"].tolist() == list(range(n // 2, n))
    assert set(out["start"]) == {100 - substrings.REACH}
    assert set(out["end"]) == {150}
    assert peak < 1200 * n


def test_empty(spark):
    assert substrings.dedup(data.empty(spark)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op9_substrings"](spark, sf)) == brute(rows)
