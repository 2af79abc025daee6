import random
import zlib

import numpy as np
import pytest

from quillet.llm import toxicity
from quillet.llm.queries import QUERIES
from tests.llm import data

CLEAN = ["the cat sat on the mat today", "we walked along the river bank", "dinner was served at eight sharp", "she reads a book every week"]
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.2)
        words = " ".join(r.sample(CLEAN, 3)).split()
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["moronic", "moron", "scum", "IDIOT!"]))
        rows.append((i, " ".join(words), "en", f"toxic{toxic}", toxic))
        labels.append((i, 1, toxic))
    return rows, labels


def test_scores(spark):
    rows, labels = corpus()
    docs, told = spark.createDataFrame(rows, data.DOCS), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, told)).collect()}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == labels[i][2] for i in held]) > 0.95


def test_held_out_labels_never_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, data.DOCS)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a, b = (sorted(toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(x, LABELS))).collect()) for x in (labels, flipped))
    assert a == b
    other = spark.createDataFrame([(i, t, None, None, None) for i, t, *_ in rows], data.DOCS)
    assert sorted(toxicity.score(other, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))).collect()) == a


@pytest.mark.parametrize("make", [data.docs, data.odd, data.empty])
def test_rows(spark, make):
    docs = make(spark)
    for labels in ([], [(1, 1, 1), (None, 1, 1), (2, None, None), (3, 1, 0)], [(i, 1, i % 2) for i in range(1, 10)]):
        got = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in got)


def test_label_model_finds_accuracies_and_copies():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y)
    first = vote(0.8)
    votes = np.stack([first, first, first, vote(0.9), vote(0.85), vote(0.95)], axis=1).astype(int)
    model = toxicity.LabelModel.fit(votes, vote(0.95).astype(float) * 0.9 + 0.05)
    edges = {frozenset((i, int(p))) for i, p in enumerate(model.parents) if p >= 0}
    assert len(edges & {frozenset(e) for e in ((0, 1), (0, 2), (1, 2))}) == 2  # copies hang together, and count once
    p = model.posterior(votes)
    assert ((p > 0.5) == y).mean() > 0.95
    apart = (votes[:, 3] == votes[:, 4]) & (votes[:, 4] == votes[:, 5]) & (votes[:, 0] != votes[:, 3])
    assert ((p[apart] > 0.5) == votes[apart, 3]).all()


def test_the_label_has_no_vote():
    """Posterior labels follow the votes: texts that vote alike are labelled alike, however their own labels differ."""
    counts = np.array([[1, 0, 1], [1, 0, 1], [0, 0, 0], [0, 1, 0]], np.float32)
    votes = toxicity.ballot(counts, np.array([3.0, 2.0, 1.0]), np.zeros((4, 2)))
    assert votes.shape == (4, toxicity.LEXICONS + 4) and set(votes[2]) == {toxicity.CLEAN, toxicity.ABSTAIN}
    assert (votes[0] == votes[1]).all() and (votes[0, :3] == [toxicity.TOXIC, toxicity.ABSTAIN, toxicity.TOXIC]).all()
    many = votes[[0] * 30 + [2] * 60]
    told = np.array([0.02] + [0.98] * 29 + [0.02] * 60)
    p = toxicity.LabelModel.fit(many, told).posterior(many)
    assert len(set(p[:30])) == 1 and p[0] > 0.9 and (p[30:] < 0.1).all()


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op6_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [r for r in got if labels[r.doc_id]]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in got if not labels[r.doc_id]) <= 0.03 * (len(got) - len(toxic))
