"""Quality rules as a short-circuit cascade.

The base figures are computed for every document. The remaining rules run in an order set by a sample: a rule's cost
(seconds a document) and its rejection rate there give rejections per second, and the best goes first. A document that
a rule rejects isn't shown to the later ones. The order changes the time only, never the verdict.

A null text has no words and fails the base rules. Repeated rows are judged each for itself. Rows keep their doc_id only.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.common import pick, repeats, slices, texts, words

SYMBOLS = b"#*$%&|<>"
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class Batch:
    """Texts with the figures that rules read; what only some rules need is computed for the texts they are shown."""

    texts: list[bytes]
    figures: dict[str, np.ndarray] = field(default_factory=dict)

    def __len__(self) -> int:
        return len(self.texts)

    def take(self, at: np.ndarray) -> Batch:
        return Batch([self.texts[i] for i in at], {k: v[at] for k, v in self.figures.items()})

    def counts(self, kind: np.ndarray) -> np.ndarray:
        """How many bytes of each text are of a kind."""
        joined = np.frombuffer(b"".join(self.texts), np.uint8)
        ends = np.cumsum([len(x) for x in self.texts])
        sums = np.concatenate([[0], np.cumsum(kind[joined], dtype=np.int64)])
        return np.diff(np.concatenate([[0], sums[ends]]))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says for a Batch which texts fail."""

    name: str
    rejects: Callable[[Batch], np.ndarray]


def _symbols(b: Batch) -> np.ndarray:
    return 10 * b.figures["n_symbols"] > b.figures["n_words"]


def _word_length(b: Batch) -> np.ndarray:
    words, chars = b.figures["n_words"], b.figures["word_chars"]
    return (chars < 2 * words) | (chars > 25 * words)


def _digits(b: Batch) -> np.ndarray:
    return 2 * b.counts(_DIGIT) > b.figures["word_chars"]


def _duplicate_lines(b: Batch) -> np.ndarray:
    lines = np.fromiter((sum(1 for x in t.split(b"\n") if x.strip()) for t in b.texts), np.int64, len(b))
    return 2 * b.figures["n_dup_lines"] > lines


def _few_kinds(b: Batch) -> np.ndarray:
    """Long texts of a handful of different words."""
    kinds = np.fromiter((len(set(t.split())) for t in b.texts), np.int64, len(b))
    return (b.figures["n_words"] >= 50) & (20 * kinds < np.minimum(b.figures["n_words"], 400))


def _stutters(b: Batch) -> np.ndarray:
    """Words that repeat the word before."""
    return 5 * b.figures["n_stutters"] > b.figures["n_words"]


RULES = (Rule("stutters", _stutters), Rule("symbols", _symbols), Rule("word_length", _word_length), Rule("digits", _digits), Rule("duplicate_lines", _duplicate_lines), Rule("few_kinds", _few_kinds))


def repeated_words(hashes: np.ndarray, owner: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """For each document, its words that lie in a window of ``width`` words found twice or more in it."""
    n = len(hashes) - width + 1
    if n < 2:
        return np.zeros(n_docs, np.int64)
    inside = np.flatnonzero(owner[:n] == owner[width - 1 :])
    key = owner[inside].astype(np.uint64)
    for k in range(width):
        key = (key ^ hashes[inside + k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    i, j = repeats(key)
    covered = np.zeros(len(hashes) + width, bool)
    for k in range(width):
        covered[inside[i] + k] = True
        covered[inside[j] + k] = True
    return np.bincount(owner[covered[: len(hashes)]], minlength=n_docs)


def figures(own: list[bytes]) -> dict[str, np.ndarray]:
    """The figures for each text. Words and windows are compared by 64-bit hashes."""
    batch = Batch(own)
    n_docs = len(own)
    n_dup = np.zeros(n_docs, np.int64)
    for k, text in enumerate(own):
        lines = [x for x in text.split(b"\n") if x.strip()]  # bytes strip and split exactly the six white-space bytes
        n_dup[k] = len(lines) - len(set(lines))
    hashes, owner = words(own)
    stutter = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    starts = (np.arange(256) & 0xC0) != 0x80
    return {
        "n_words": np.bincount(owner, minlength=n_docs),
        "word_chars": batch.counts(starts & ~_SPACE),
        "n_symbols": batch.counts(_SYMBOL),
        "n_dup_lines": n_dup,
        "n_repeat_words": repeated_words(hashes, owner, n_docs),
        "n_stutters": np.bincount(owner[stutter], minlength=n_docs),
    }


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 200) -> list[str]:
    """Names of the rules, the most rejections per second first, on a bounded sample of ``sample_rows`` documents.

    The sample sets the order and so the time only: any order gives the same verdicts."""
    drawn = [(r.text or "").encode() for r in docs.select("text").limit(sample_rows).collect()]
    if not drawn:
        return [r.name for r in rules]
    batch = Batch(drawn, figures(drawn))
    score = {}
    for rule in rules:
        began = time.perf_counter()
        share = float(np.mean(rule.rejects(batch)))
        score[rule.name] = (share + 1e-6) / max(time.perf_counter() - began, 1e-9)
    return sorted(score, key=lambda n: (-score[n], n))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None) -> DataFrame:
    """doc_id, the figures, base_failed, kept, and rejected_by (the first rule that failed, or null)."""
    docs = pick(docs, "doc_id", "text")
    by_name = {r.name: r for r in rules}
    cascade = [by_name[n] for n in (order or plan(docs, rules))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = Batch(texts(b))
            batch.figures = figures(batch.texts)
            failed = base_failed(batch.figures)
            why: list[str | None] = ["base" if x else None for x in failed]
            alive = np.flatnonzero(~failed)
            for rule in cascade:
                if not len(alive):
                    break
                bad = np.asarray(rule.rejects(batch.take(alive)), bool)
                for i in alive[bad]:
                    why[i] = rule.name
                alive = alive[~bad]
            kept = np.zeros(len(batch), bool)
            kept[alive] = True
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v) for v in batch.figures.values()], pa.array(failed), pa.array(kept), pa.array(why, pa.string())], names=["doc_id", *batch.figures, "base_failed", "kept", "rejected_by"])

    return docs.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_stutters long, base_failed boolean, kept boolean, rejected_by string")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, whole rows, in one pass: the verdict rides beside the row's other columns."""
    order, schema = plan(pick(docs, "text")), docs.schema
    by_name = {r.name: r for r in RULES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            batch = Batch(texts(b))
            batch.figures = figures(batch.texts)
            alive = np.flatnonzero(~base_failed(batch.figures))
            for name in order:
                if len(alive):
                    alive = alive[~np.asarray(by_name[name].rejects(batch.take(alive)), bool)]
            yield b.take(pa.array(alive))

    return docs.mapInArrow(run, schema)
