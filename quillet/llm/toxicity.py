"""Toxicity by weak supervision.

A bounded sample of labelled rows gives terms (words and word beginnings) that toxic texts use more. They are dealt to
many lexicon voters, which abstain where they find none; others watch how many different terms there are, shouting and
exclamation. The label itself has no vote. A generative label model, fitted by a few rounds of expectation-maximisation
that begin at the labels, estimates how right every voter is and, as a tree of the strongest conditional dependences,
which voters repeat each other. A linear classifier is trained on its posterior labels and scores every text by its
counts of the terms and its patterns.

The inputs of a score are the text alone. A null or empty text scores like any text without terms. Rows that repeat
score alike, and long ones as a whole. Only ``doc_id``, ``text`` and ``toxic`` are read, so other columns may have any
name; an empty table gives an empty result, and of terms equally strong the one of the least hash is taken. Without a labelled row of either kind, every text gets the constant share of toxic labels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import pick, slices, texts, word_spans

FOLDS = 5
#: Labelled rows, terms and voters that a fit uses at most.
SAMPLE_ROWS, MOST_TERMS, LEXICONS = 6_000, 400, 100
#: How far a term's likelihood ratio must be from chance (chi-squared with one degree of freedom).
SURE = 24.0
#: Rounds of expectation-maximisation. Later ones drift from what is toxic to what else the voters agree on.
ROUNDS = 3
PREFIXES = (4, 5, 6, 7, 8, 9)
_PARTS = np.ones(256, bool)
_PARTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def terms(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of the texts and of their beginnings, with the text's index for each."""
    lower = [t.decode("utf-8", "replace").lower().encode() for t in own]
    found = word_spans(np.frombuffer(b" ".join(lower), np.uint8), _PARTS, PREFIXES)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in lower]), found[1], side="right")
    hashes, owners = [found[0]], [owner]
    for head in found[3:]:
        real = head != 0
        hashes.append(head[real])
        owners.append(owner[real])
    return np.concatenate(hashes), np.concatenate(owners)


def patterns(own: list[bytes]) -> np.ndarray:
    """For each text: share of capitals among its ASCII letters, and exclamation marks a word."""
    data = np.frombuffer(b"".join(own), np.uint8)
    ends = np.cumsum([len(x) for x in own])

    def count(kind: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])[ends]]))

    upper, marks, gaps = count(_UPPER), count(_MARK), count(_GAP)
    return np.stack([upper / np.maximum(count(_LETTER), 1), np.minimum(2.0, marks / (gaps + 1))], axis=1)


def _bytes(*of: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_UPPER, _LETTER, _MARK, _GAP = _bytes(*range(65, 91)), _bytes(*range(65, 91), *range(97, 123)), _bytes(33), _bytes(32, 10)


class Lookup:
    """Counts of a few thousand known hashes in many."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = np.sort(known)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def counts(self, hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        if not len(self.known):
            return np.zeros((n, 0), np.float32)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.known, hashes[maybe])
        at[at == len(self.known)] = 0
        hit = self.known[at] == hashes[maybe]
        flat = np.bincount(owner[maybe][hit] * len(self.known) + at[hit], minlength=n * len(self.known))
        return flat.reshape(n, len(self.known)).astype(np.float32)


CLEAN, TOXIC, ABSTAIN = 0, 1, 2


@dataclass(frozen=True)
class LabelModel:
    """Voters on a tree: P(vote | toxic or not, the parent's vote). ``parents`` is -1 at the root."""

    prior: float
    parents: np.ndarray
    tables: np.ndarray  # [voter, class, parent's vote, vote]

    @classmethod
    def fit(cls, votes: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """``start``: a first guess of P(toxic) for each row, which says what the classes mean; how right each voter is,
        how often it abstains and which voters depend on each other is estimated from the votes alone."""
        p, model = start.astype(float), None
        # every table leans by one row to the voter's votes overall, so that what is rarely seen says little
        overall = [((votes == v).sum(0) + 0.1) / (len(votes) + 0.3) for v in range(3)]
        for _ in range(rounds):
            parents = _tree(votes, p)
            seen = np.where(parents[None, :] >= 0, votes[:, parents], ABSTAIN)
            tables = np.zeros((votes.shape[1], 2, 3, 3))
            for y, weight in enumerate((1 - p, p)):
                for q in range(3):
                    w = weight[:, None] * (seen == q)
                    for v in range(3):
                        tables[:, y, q, v] = ((w * (votes == v)).sum(0) + overall[v]) / (w.sum(0) + 1)
            model = cls(float(np.clip(p.mean(), 1e-6, 1 - 1e-6)), parents, tables)
            p = model.posterior(votes)
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        seen = np.where(self.parents[None, :] >= 0, votes[:, self.parents], ABSTAIN)
        voter = np.arange(votes.shape[1])[None, :]
        logs = [np.log(self.tables[voter, y, seen, votes]).sum(1) + np.log((1 - self.prior, self.prior)[y]) for y in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def _tree(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The spanning tree of most conditional mutual information between voters, given the class."""
    n = votes.shape[1]
    gain = np.zeros((n, n))
    for weight in (1 - p, p):
        total = weight.sum() + 9
        for a in range(3):
            for b in range(3):
                both = ((weight[:, None] * (votes == a)).T @ (votes == b).astype(float) + 1) / total
                pa_, pb = (weight @ (votes == a) + 3) / total, (weight @ (votes == b) + 3) / total
                gain += (total / (len(votes) + 18)) * both * np.log(both / np.outer(pa_, pb))
    parents, inside = np.full(n, -1), [0]
    while len(inside) < n:
        outside = [i for i in range(n) if i not in inside]
        part = gain[np.ix_(inside, outside)]
        i, j = np.unravel_index(np.argmax(part), part.shape)
        parents[outside[j]] = inside[i]
        inside.append(outside[j])
    return parents


def ballot(counts: np.ndarray, odds: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """The votes on texts with these counts of terms: lexicons, which the terms are dealt to by strength, numbers of
    different terms, capitals and exclamation marks. A lexicon that finds nothing abstains; what finds nothing at all votes clean."""
    dealt = np.argsort(-odds, kind="stable")
    kinds = (counts > 0).sum(1)
    says = [(counts[:, dealt[k::LEXICONS]].sum(1) > 0, None) for k in range(LEXICONS)]
    says += [(kinds >= 2, kinds == 0), (kinds >= 4, kinds <= 1), (shape[:, 0] > 0.6, None), (shape[:, 1] > 0.4, None)]
    return np.stack([np.where(yes, TOXIC, ABSTAIN if no is None else np.where(no, CLEAN, ABSTAIN)) for yes, no in says], axis=1)


@dataclass(frozen=True)
class Model:
    terms: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, own: list[bytes]) -> np.ndarray:
        hashes, owner = terms(own)
        x = np.hstack([np.minimum(Lookup(self.terms).counts(hashes, owner, len(own)), 3), patterns(own)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -50, 50)))


def train(own: list[bytes], toxic: np.ndarray) -> Model:
    toxic = np.asarray(toxic, float)
    share = float((toxic.sum() + 0.5) / (len(toxic) + 1))
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.uint64), np.zeros(2), float(np.log(share / (1 - share))))
    hashes, owner = _promising(own, toxic)
    chosen, odds = _chosen(hashes, owner, toxic)
    lookup = Lookup(chosen)
    counts = lookup.counts(hashes, owner, len(own))
    odds = odds[np.argsort(chosen)]
    shape = np.concatenate([patterns(own[i : i + 1000]) for i in range(0, len(own), 1000)])
    votes = ballot(counts, odds, shape)
    posterior = LabelModel.fit(votes, np.clip(toxic, 0.02, 0.98)).posterior(votes)
    x = np.hstack([np.minimum(counts, 3), shape]).astype(np.float32)
    weights, bias = _linear(x, posterior)
    return Model(lookup.known, weights, bias)


def _ratio(in_toxic: np.ndarray, in_all: np.ndarray, t: float, n: int) -> np.ndarray:
    """Twice the log likelihood ratio against chance, 0 where the odds aren't clearly up; the bar is high as very many terms are tried."""
    rate, base = (in_toxic + 0.5) / (in_all + 1), (t + 0.5) / (n + 1)
    cells = ((in_toxic, in_all * t / n), (in_all - in_toxic, in_all * (n - t) / n), (t - in_toxic, (n - in_all) * t / n), (n - in_all - t + in_toxic, (n - in_all) * (n - t) / n))
    ratio = 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(chance, 1e-9)), 0) for seen, chance in cells)
    return np.where((np.log(rate / (1 - rate)) - np.log(base / (1 - base)) > 1) & (ratio > SURE), ratio, 0)


def _promising(own: list[bytes], toxic: np.ndarray, chunk: int = 200, slots: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Terms and owners, of the terms only whose hash slots stand out: what is held at once stays small."""
    in_all, in_toxic = np.zeros(slots), np.zeros(slots)
    for i in range(0, len(own), chunk):
        h, o = terms(own[i : i + chunk])
        slot = (h & np.uint64(slots - 1)).astype(np.int64)
        pair = np.unique(slot * chunk + o)
        in_all += np.bincount(pair // chunk, minlength=slots)
        in_toxic += np.bincount(pair // chunk, weights=toxic[i + pair % chunk], minlength=slots)
    stands_out = _ratio(in_toxic, in_all, toxic.sum(), len(toxic)) > 0
    hashes, owner = [], []
    for i in range(0, len(own), chunk):
        h, o = terms(own[i : i + chunk])
        mine = stands_out[(h & np.uint64(slots - 1)).astype(np.int64)]
        hashes.append(h[mine])
        owner.append(o[mine] + i)
    return np.concatenate(hashes), np.concatenate(owner)


def _chosen(hashes: np.ndarray, owner: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms whose documents are toxic far more often than chance, the strongest first, with their log odds."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0)
    order = np.lexsort((owner, hashes))
    h, o = hashes[order], owner[order]
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    h, o = h[once], o[once]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    in_all = np.diff(np.append(first, len(h)))
    in_toxic = np.add.reduceat(toxic[o], first)
    n, t = len(toxic), toxic.sum()
    rate, base = (in_toxic + 0.5) / (in_all + 1), (t + 0.5) / (n + 1)
    odds = np.log(rate / (1 - rate)) - np.log(base / (1 - base))
    strength = _ratio(in_toxic, in_all, t, n)
    best = np.argsort(-strength, kind="stable")[:MOST_TERMS]
    best = best[strength[best] > 0]
    return h[first[best]], odds[best]


def _linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with momentum; columns are scaled for the steps only."""
    scale = np.maximum(x.std(0), 1e-2)
    z = (x / scale).astype(np.float32)
    w, b, vw, vb, mw, mb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    weight = np.where(y > 0.5, min(0.5 / max(y.mean(), 1e-3), 8.0), 1.0)  # toxic texts are few
    for k in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32) + b, -50, 50))) - y) * weight / len(y)
        gw, gb = z.T @ error.astype(np.float32) + ridge * w, float(error.sum())
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw**2, 0.999 * vb + 0.001 * gb**2
        fix = (1 - 0.9**k) / np.sqrt(1 - 0.999**k)
        w -= 0.03 * mw / (np.sqrt(vw) + 1e-8) / fix
        b -= 0.03 * mb / (np.sqrt(vb) + 1e-8) / fix
        w = np.maximum(w, 0)  # evidence is for toxicity only: nothing in a text excuses what else it says
    return w / scale, float(b)


def held_out(doc_id):  # noqa: ANN001, ANN201
    """Rows kept from training: a Column for a Column, a bool for a number."""
    if isinstance(doc_id, int):
        return zlib.crc32(str(doc_id).encode()) % FOLDS == 0
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on at most about ``sample_rows`` labelled rows outside the held-out fold, drawn by a hash of doc_id."""
    told = pick(labels, "doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    n = told.count()
    if n > sample_rows:
        told = told.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    drawn = pick(docs, "doc_id", "text").join(told, "doc_id").select("doc_id", "text", "toxic").toArrow().sort_by("doc_id").combine_chunks()
    return train(texts(drawn), np.array(drawn.column("toxic").to_pylist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
