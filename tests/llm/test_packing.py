import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillet.llm import packing
from quillet.llm.queries import PACKING_VOCABULARY, QUERIES, vocabulary
from tests.llm import data

VOCABULARY = vocabulary(PACKING_VOCABULARY)


def total(shapes):
    out = Counter()
    for s in shapes:
        for x in s.lengths:
            out[x] += s.count
    return +out


def fewest(items, capacity):
    best, items = len(items), sorted(items, reverse=True)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for room in set(bins):
            if room >= items[i]:
                rest = list(bins)
                rest.remove(room)
                place(i + 1, [*rest, room - items[i]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_solver(seed):
    r = random.Random(seed)
    items = [r.randint(1, 20) for _ in range(r.randint(0, 9))]
    shapes = packing.solve(Counter(items), 20)
    assert total(shapes) == Counter(items)
    assert all(sum(s.lengths) <= 20 and s.count > 0 for s in shapes)
    assert sum(s.count for s in shapes) <= fewest(items, 20) + 1
    left = Counter(items)
    fixed = packing.reduce_dominated(left, 20)  # sets that are fixed never cost a sequence
    assert sum(s.count for s in fixed) + fewest(list(left.elements()), 20) == fewest(items, 20)


def test_best_fit_in_numbers_is_best_fit():
    r = random.Random(3)
    items = sorted((r.randint(1, 64) for _ in range(400)), reverse=True)
    rooms = []
    for x in items:
        fit = [i for i, room in enumerate(rooms) if room >= x]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= x
        else:
            rooms.append(64 - x)
    got = packing.best_fit(Counter(items), 64)
    assert sum(s.count for s in got) == len(rooms)
    assert Counter({64 - sum(s.lengths): 0 for s in got}).keys() == set(rooms)


def test_large_histogram():
    r = random.Random(1)
    counts = Counter({k: r.randint(1, 10**9) for k in range(1, 2049)})
    shapes = packing.solve(counts)
    assert total(shapes) == counts
    bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(s.count for s in shapes) <= 1.05 * max(bound, sum(v for k, v in counts.items() if k > 1024))


def check(got, texts, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text in texts:
        ids = np.asarray([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[(doc_id, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return by


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    got = packing.pack(make(spark), VOCABULARY).collect()
    check(got, [(r[0], r[1]) for r in data.rows()])


def test_small_capacity_and_empty(spark):
    got = packing.pack(data.docs(spark), VOCABULARY, capacity=16).collect()
    check(got, [(r[0], r[1]) for r in data.rows()], 16)
    assert packing.pack(data.empty(spark), VOCABULARY).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = QUERIES["op1_packing"](spark, sf).collect()
    by = check(got, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1


def test_odd_characters():
    from quillet.llm.wordbpe import WordBpe

    bpe = WordBpe.of(VOCABULARY)
    odd = ["", "  ", "İstanbul ΣΑΣ don't I'LL", "naïve ½ ² ǅ 12a3", "a\x00b", "x<|endoftext|>y", "\x0bq\x1cz", "é", "日本語 text", "it's they're", "\u00a0a\u0085b", "..!?'s"]
    assert [list(x) for x in bpe.encode(odd)] == [bpe.library.encode(x, add_special_tokens=False).ids for x in odd]


def test_every_token_is_its_own_best_merge():
    """So merging by the rank of what comes out equals merging by the vocabulary's own pairs."""
    from quillet.llm.wordbpe import WordBpe

    bpe = WordBpe.of(VOCABULARY)
    words = [t[:-4] for t in bpe.library.get_vocab() if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()][:20000]
    for got, want in zip(bpe.encode(words), bpe.library.encode_batch(words, add_special_tokens=False), strict=True):
        assert list(got) == want.ids
