from collections import Counter

import corpus_pipeline
from quillet.llm import mixing
from tests.llm import data
from tests.llm.test_lines import brute as dropped_lines
from tests.llm.test_minhash import brute as classes
from tests.llm.test_packing import check
from tests.llm.test_quality import brute as figures

SF = "/root/testdata/sf0.001"


def passes(text):
    n, chars, symbols, dup, repeated = figures(text)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return not (
        n < 10 or 100 * repeated > 20 * n or 5 * stutters > n or 10 * symbols > n or chars < 2 * n or chars > 25 * n
        or 2 * sum(c in "0123456789" for c in text) > chars or 2 * dup > len(lines) or (n >= 50 and 20 * len(set(words)) < min(n, 400))
    )


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = docs.columns
    held = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == names
        held.append(docs.collect())
    want = {i: t for i, t in rows.items() if passes(t)}
    assert {r.doc_id: r.text for r in held[0]} == want
    gone = dropped_lines(sorted(want.items()))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in want.items()}
    want = {i: t for i, t in want.items() if t.split()}
    assert {r.doc_id: r.text for r in held[1]} == want and all(r.n_chars == len(r.text) for r in held[1])
    of = classes(sorted(want.items()))
    want = {i: t for i, t in want.items() if of[i] == i}
    assert {r.doc_id: r.text for r in held[2]} == want
    third = spark.createDataFrame(held[2], spark.read.parquet(f"{SF}/documents.parquet").schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert Counter(r.doc_id for r in held[3]) == Counter({i: n for i, n in copies.items() if n})
    check(held[4], [(r.doc_id, r.text) for r in held[3]])


def test_empty(spark):
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
