import random

import numpy as np
import pytest

from quillet.llm import quality
from quillet.llm.common import kinds, repeats
from quillet.llm.queries import ORACLE, QUERIES
from tests.llm import data
from tests.oracle import rows, sql_rows


def brute(text):
    words, lines = (text or "").split(" "), [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


@pytest.mark.parametrize("make", [data.docs, data.odd])
def test_rows(spark, make):
    got = quality.judge(make(spark)).collect()
    as_key = lambda d: str(d)
    want = sorted(((as_key(r[0]), *brute(r[1])) for r in data.rows()))
    assert sorted((as_key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    assert {r.doc_id for r in got if r.kept} == {1, 2, 5, 8, None}


def test_figures_random():
    r = random.Random(5)
    texts = ["".join(r.choice(["a", "b", "é", " ", "\n", "\t", "#", "a b c d e "]) for _ in range(r.randint(0, 120))) for _ in range(300)]
    f = quality.figures([t.encode() for t in texts])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(f[n][i]) for n in names) for i in range(300)] == [brute(t) for t in texts]


def test_order_never_changes_the_verdict(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [r.name for r in quality.RULES]
    assert sorted(quality.plan(df)) == sorted(names) and quality.plan(data.empty(spark)) == names
    a, b = (sorted((r.doc_id, r.kept) for r in quality.judge(df, order=o).collect()) for o in (names, names[::-1]))
    assert a == b
    assert sorted(r.doc_id for r in quality.keep(df).collect()) == [d for d, k in a if k]
    assert quality.keep(df).schema == df.schema and quality.keep(data.empty(spark)).count() == 0


def test_equal_keys():
    keys = np.array([5, 3, 5, 9, 3, 5], np.uint64) << np.uint64(40)
    i, j = repeats(keys)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 2), (1, 4), (2, 5)]
    close = np.array([1, 2, 1, 3], np.uint64)  # equal in the upper bits
    assert [(int(a), int(b)) for a, b in zip(*repeats(close), strict=True)] == [(0, 2)]
    first, rank = kinds(close)
    assert (close[first][rank] == close).all() and len(first) == 3


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert rows(QUERIES["op8_quality"](spark, sf)) == sql_rows(ORACLE["op8_quality"], sf)


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    assert got.where("quality = 1 and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() <= 0.1 * got.where("quality = 0").count()
