"""Ids of a word-level BPE vocabulary (lower case, word ends marked), by a fast path for common letters.

The vocabulary's merges are given to a byte-level merger, where a byte that no UTF-8 text has stands for the word's end.
Each rank is the token's id, so merges come in the vocabulary's own order. Texts with characters whose case, form or
class libraries could see differently, and texts with the vocabulary's special strings, go to its own library.
"""

from __future__ import annotations

import json
from functools import cached_property

import numpy as np
import regex

from quillet.llm.common import kinds, word_spans

_PLAIN = regex.compile("[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]*")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_HELD: dict[str, WordBpe] = {}


def _letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: bytes that print stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    END = "\x00"

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path) as f:  # a vocabulary file that the worker's Python installation brings
            data = json.load(f)
        letters, ranks = _letters(), {}
        suffix = data["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in data["added_tokens"]]
        for token, i in data["model"]["vocab"].items():
            if token in self.special:
                continue
            end = token.endswith(suffix)
            ranks[bytes(letters[c] for c in (token[: -len(suffix)] if end else token)) + self.END.encode() * end] = i
        # the end mark is a byte of its own here: texts that hold it take the library's path
        self.fast = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})

        self.ends = np.zeros(max(ranks.values()) + 1, bool)
        self.ends[[i for t, i in ranks.items() if len(t) > 1 and t.endswith(self.END.encode())]] = True
        self.most_known = 300_000
        self.forget()

    @cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def of(cls, path: str) -> WordBpe:
        if path not in _HELD:
            _HELD[path] = cls(path)
        return _HELD[path]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. White space parts words and leaves no ids, so a word is encoded once and then looked up."""
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and not any(s in t for s in self.special)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in set(range(len(texts))) - set(plain):
            out[i] = np.asarray(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        own = [texts[i].encode() for i in plain]
        data = b" ".join(own)
        hashes, start, end = word_spans(np.frombuffer(data, np.uint8))
        if not len(hashes):
            return out
        first, kind = kinds(hashes)
        if len(self.known) + len(first) > self.most_known:
            self.forget()
        keys = hashes[first].tolist()
        fresh = [k for k, h in enumerate(keys) if h not in self.known]
        if fresh:
            self.learn([keys[k] for k in fresh], [data[start[first[k]] : end[first[k]]].decode() for k in fresh])
        place = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))[kind]
        begins, counts = self.begin[place], self.count[place]
        ends = np.cumsum(counts)
        ids = self.pool[np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)]
        last = np.searchsorted(start, np.cumsum([len(x) + 1 for x in own]), side="left")  # words before the text's end
        cuts = np.concatenate([[0], ends])[last]
        for i, a, b in zip(plain, [0, *cuts[:-1]], cuts, strict=True):
            out[i] = ids[a:b]
        return out

    def forget(self) -> None:
        """Bounds the memory of what was looked up."""
        self.known: dict[int, int] = {}
        self.begin = self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def learn(self, keys: list[int], fresh: list[str]) -> None:
        parts, sizes = [], []
        for w in fresh:
            w = w.lower()
            found = [w] if w.isalpha() else _WORDS.findall(w)
            parts += found
            sizes.append(len(found))
        ids = self.fast.encode_to_numpy(self.END.join(parts) + self.END, disallowed_special=())
        after = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])  # where each part's ids end
        edges = after[np.concatenate([[0], np.cumsum(sizes)])]
        self.known.update(zip(keys, range(len(self.begin), len(self.begin) + len(keys)), strict=True))
        self.begin = np.concatenate([self.begin, edges[:-1] + len(self.pool)])
        self.count = np.concatenate([self.count, np.diff(edges)])
        self.pool = np.concatenate([self.pool, ids])
