"""Greedy longest-match word-piece lengths by a linear automaton.

The vocabulary is a trie of byte strings. A node that no longer extends falls back along its failure link, which leads
to the node for what is left once the pieces that greedy matching settles are popped; how many were popped is kept with
the link. Each byte of a word is read once, and no piece is ever built. Words are read with a space in front, as
word-initial pieces have one, and a word met before is looked up.

A null or empty text has no tokens. A byte outside the vocabulary makes its word one unknown token.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillet.llm.common import kinds, pick, slices, texts, word_spans
from quillet.llm.wordbpe import _letters


class Automaton:
    """States are numbers; 0 is the root. ``edges`` maps state * 256 + byte to the next state."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.edges: dict[int, int] = {}
        accepts, depth_order, parent = {0: False}, [0], {0: (0, 0)}
        for piece in pieces:
            u = 0
            for c in piece:
                v = self.edges.get(u << 8 | c)
                if v is None:
                    v = self.edges[u << 8 | c] = len(accepts)
                    accepts[v], parent[v] = False, (u, c)
                    depth_order.append(v)
                u = v
            if piece:
                accepts[u] = True
        level = {0: 0}
        for v in depth_order[1:]:  # a parent is always made before its children
            level[v] = level[parent[v][0]] + 1
        self.link = [-1] * len(accepts)  # -1: nothing to fall back to
        self.pops = [0] * len(accepts)
        for v in sorted(depth_order[1:], key=level.__getitem__):
            if accepts[v]:
                self.link[v], self.pops[v] = 0, 1
                continue
            u, c = parent[v]
            z, popped = self.link[u], self.pops[u]
            while z >= 0 and (z << 8 | c) not in self.edges:
                popped += self.pops[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.pops[v] = self.edges[z << 8 | c], popped
        keys = np.fromiter(self.edges, np.int64, len(self.edges))
        order = np.argsort(keys)
        self._keys, self._next = keys[order], np.fromiter(self.edges.values(), np.int64, len(keys))[order]
        self._link, self._pops = np.array(self.link), np.array(self.pops)

    def count(self, word: bytes) -> int:
        """Pieces of one word; 1 if greedy matching can't split it all."""
        u, n = 0, 0
        for c in word:
            v = self.edges.get(u << 8 | c)
            while v is None:
                n += self.pops[u]
                u = self.link[u]
                if u < 0:
                    return 1
                v = self.edges.get(u << 8 | c)
            u = v
        while u:
            n += self.pops[u]
            u = self.link[u]
            if u < 0:
                return 1
        return n

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state << 8 | byte
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._next[at], -1)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``count`` for many words of ``data``, all a byte further at once."""
        out = np.zeros(len(start), np.int64)
        state = np.zeros(len(start), np.int64)
        live = np.flatnonzero(end > start)
        at = start.copy()
        while len(live):
            go = self._step(state[live], data[at[live]].astype(np.int64))
            stuck = live[go < 0]
            moved = live[go >= 0]
            state[moved] = go[go >= 0]
            at[moved] += 1
            if len(stuck):
                out[stuck] += self._pops[state[stuck]]
                state[stuck] = self._link[state[stuck]]
                lost = stuck[state[stuck] < 0]
                out[lost], at[lost], state[lost] = 1, end[lost], 0
            live = live[at[live] < end[live]]
        live = np.flatnonzero(state > 0)
        while len(live):
            out[live] += self._pops[state[live]]
            state[live] = self._link[state[live]]
            out[live[state[live] < 0]] = 1
            live = live[state[live] > 0]
        return out


class Counter:
    """An automaton for a vocabulary file, with the counts of words met."""

    _held: dict[str, Counter] = {}

    def __init__(self, path: str, most_known: int = 500_000, long_word: int = 64) -> None:
        self.automaton = Automaton(vocabulary(path))
        self.known: dict[int, int] = {}
        self.most_known, self.long_word = most_known, long_word

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def count(self, own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        raw = b" " + b" ".join(own)
        data = np.frombuffer(raw, np.uint8)
        hashes, start, end = word_spans(data)
        owner = np.searchsorted(np.cumsum([len(x) + 1 for x in own]) + 1, start, side="right")
        n_words = np.bincount(owner, minlength=len(own))
        if not len(hashes):
            return n_words, np.zeros(len(own), np.int64)
        first, kind = kinds(hashes)
        if len(self.known) + len(first) > self.most_known:
            self.known = {}
        keys = hashes[first].tolist()
        fresh = np.array([k for k, h in enumerate(keys) if h not in self.known], np.int64)
        long = fresh[(end - start)[first[fresh]] > self.long_word] if len(fresh) else fresh
        short = np.setdiff1d(fresh, long, assume_unique=True)
        if len(short):
            spaced = data
            if (bad := start[first[short]][data[start[first[short]] - 1] != 32]).size:  # another kind of white space before it
                spaced = data.copy()
                spaced[bad - 1] = 32
            self.known.update(zip([keys[k] for k in short], self.automaton.counts(spaced, start[first[short]] - 1, end[first[short]]).tolist(), strict=True))
        for k in long:
            self.known[keys[k]] = self.automaton.count(b" " + raw[start[first[k]] : end[first[k]]])
        each = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))[kind]
        return n_words, np.bincount(owner, weights=each, minlength=len(own)).astype(np.int64)


def vocabulary(path: str) -> list[bytes]:
    """The byte strings of a byte-level vocabulary file, without its special tokens."""
    with open(path) as f:  # a file of the worker's own Python installation
        data = json.load(f)
    letters, special = _letters(), {t["content"] for t in data["added_tokens"]}
    return [bytes(letters[c] for c in t) for t in data["model"]["vocab"] if t not in special]


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words and n_tokens for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for b in slices(batches):
            n_words, n_tokens = counter.count(texts(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
