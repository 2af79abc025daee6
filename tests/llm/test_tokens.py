import random

import pytest

from quillet.llm import tokens
from quillet.llm.queries import QUERIES, TOKEN_VOCABULARY, vocabulary
from tests.llm import data

PATH = vocabulary(TOKEN_VOCABULARY)


def greedy(word, pieces, longest):
    n, i = 0, 0
    while i < len(word):
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    r = random.Random(seed)
    make = lambda n: bytes(r.choice(b"abc") for _ in range(r.randint(1, n)))
    pieces = {make(5) for _ in range(12)} | ({b"a", b"b", b"c"} if seed % 2 else set())
    a = tokens.Automaton(sorted(pieces))
    import numpy as np

    words = [make(14) for _ in range(200)]
    joined = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    many = a.counts(joined, end - [len(w) for w in words], end)
    for w, m in zip(words, many, strict=True):
        assert a.count(w) == greedy(w, pieces, 5) == m, w


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    pieces = set(tokens.vocabulary(PATH))
    longest = max(map(len, pieces))
    want = sorted((str(r[0]), len((r[1] or "").encode().split()), sum(greedy(b" " + w, pieces, longest) for w in (r[1] or "").encode().split())) for r in data.rows())
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens) for r in tokens.count_tokens(make(spark), PATH).collect()) == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pieces = set(tokens.vocabulary(PATH))
    longest = max(map(len, pieces))
    want = {r.doc_id: sum(greedy(b" " + w, pieces, longest) for w in r.text.encode().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op7_tokens"](spark, sf).collect()} == want


def test_empty_and_long(spark):
    assert tokens.count_tokens(data.empty(spark), PATH).count() == 0
    counter = tokens.Counter(PATH, most_known=10)
    long = b"x" * 70000
    assert counter.count([long, b"", b"a\tb\x0bc"])[0].tolist() == [1, 0, 3]
    assert counter.count([long])[1][0] == counter.automaton.count(b" " + long)
