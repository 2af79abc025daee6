"""MinHash near-dedup of documents by DartMinHash.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs. Over every unit of
weight hashed darts fall as a Poisson process along a rank axis; a document keeps its darts below a rank that lets
about k ln k + 2k through, whatever its length, and each of k coordinates keeps its earliest dart (a document with an
empty coordinate throws on). Two documents agree on a coordinate with probability their weighted Jaccard similarity.
Bands of coordinates give candidates, which are verified exactly and united.

Exact copies are one class before any of this. Texts of one to four words have one shingle, the whole text. Texts
without words, null among them, stay apart from all others. Rows that repeat an id and its text share a class; a null
id is a document like others and never names a class that has another id. What stays is decided by row, not by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import kinds, mixed, pick, slices, texts, words
from quillet.llm.links import BITS, classes, only
from quillet.session import cut, discard

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4
#: Bytes of text that a worker takes apart at once: each needs about a hundred bytes of arrays.
SLICE = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(own: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles, with the text's index for each; both in order of the text."""
    hashes, owner = words(own)
    n = np.bincount(owner, minlength=len(own))
    key = np.zeros(0, np.uint64)
    inside = np.zeros(0, np.int64)
    if len(hashes) >= width:
        inside = np.flatnonzero(owner[: len(hashes) - width + 1] == owner[width - 1 :])
        key = np.full(len(inside), width, np.uint64)
        for k in range(width):
            key = mixed(key ^ hashes[inside + k])
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        begin = np.cumsum(n) - n
        extra = []
        for i in few:
            h = np.uint64(n[i])
            for w in hashes[begin[i] : begin[i] + n[i]]:
                h = mixed(np.array([h ^ w]))[0]
            extra.append(h)
        of = np.concatenate([owner[inside], few])
        order = np.argsort(of, kind="stable")
        return np.concatenate([key, np.array(extra, np.uint64)])[order], of[order]
    return key, owner[inside]


def multisets(own: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's different shingles: (shingle, text, weight)."""
    key, owner = shingles(own, width)
    first, kind = kinds(mixed(key ^ mixed(owner.astype(np.uint64) * _ODD)))
    return key[first], owner[first], np.bincount(kind, minlength=len(first)).astype(np.float64)


def darts(key: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each document, k coordinates' earliest darts, and whether it has any weight. Weights are any positive numbers."""
    layers = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(key)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    cell = mixed(key[at] ^ (layer.astype(np.uint64) * _ODD + np.uint64(seed)))
    height, doc = weight[at] - layer, owner[at]
    total = np.bincount(owner, weights=weight, minlength=n_docs)
    out = np.zeros((n_docs, k), np.uint64)
    reach = (k * np.log(k) + 2 * k) / np.where(total > 0, total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.flatnonzero(np.isin(doc, todo)) if len(todo) < n_docs else np.arange(len(doc))
        c, d, h = cell[mine], doc[mine], height[mine]
        rank = np.zeros(len(c))
        best = np.full(n_docs * k, np.inf)
        slots, ranks, ids = [], [], []
        throw = 0
        while len(c):
            dart = mixed(c + np.uint64(throw) * _ODD)
            rank = rank - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            live = rank < reach[d]
            c, d, h, rank, dart = c[live], d[live], h[live], rank[live], dart[live]
            spot = mixed(dart ^ _ODD)
            low = (spot >> np.uint64(32)).astype(np.float64) / (1 << 32) < h  # under the weight, where the top unit is partial
            slot = d[low] * k + (spot[low] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            slots.append(slot)
            ranks.append(rank[low])
            ids.append(dart[low])
            throw += 1
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(ids)
        np.minimum.at(best, slot, rank)
        won = rank == best[slot]
        flat = np.zeros(n_docs * k, np.uint64)
        flat[slot[won]] = dart[won]
        full = np.isfinite(best.reshape(n_docs, k)).all(axis=1)
        done = todo[full[todo]]
        out[done] = flat.reshape(n_docs, k)[done]
        todo = todo[~full[todo]]
        reach[todo] *= 2
    return out, total > 0


def banded(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A hash for each band of ``rows`` coordinates."""
    n, k = signatures.shape
    out = np.tile(np.arange(k // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        out = mixed(out * _ODD ^ signatures[:, j::rows])
    return out


def _copies(docs: DataFrame) -> DataFrame:
    """The text's two hashes, 128 bits together, name its class of exact copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return pick(docs, "doc_id", "text").select("doc_id", text.alias("text"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(text, F.lit(2)).alias("h2"))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, h1, h2 and bands; bands are null where the text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            own = texts(b)
            signatures, any_word = darts(*multisets(own, width), len(own), bands * rows)
            flat = banded(signatures, rows).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat.ravel()))
            lists = pa.array([x if w else None for x, w in zip(lists, any_word, strict=True)], lists.type) if not any_word.all() else lists
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h1"), b.column("h2"), lists], names=["doc_id", "h1", "h2", "bands"])

    return _copies(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, bands array<long>")


def distance(batch: pa.RecordBatch, width: int = WIDTH) -> np.ndarray:
    """1 - weighted Jaccard similarity of the texts in columns ta and tb."""
    a, b = texts(batch, "ta"), texts(batch, "tb")
    index: dict[bytes, int] = {}
    pairs = [(index.setdefault(x, len(index)), index.setdefault(y, len(index))) for x, y in zip(a, b, strict=True)]
    key, owner, weight = multisets(list(index), width)
    order = np.lexsort((key, owner))
    key, owner, weight = key[order], owner[order], weight[order]
    ends = np.searchsorted(owner, np.arange(len(index)), side="right")
    begins = np.searchsorted(owner, np.arange(len(index)), side="left")
    sums = np.bincount(owner, weights=weight, minlength=len(index))
    out = np.ones(len(pairs))
    for i, (x, y) in enumerate(pairs):
        kx, ky = key[begins[x] : ends[x]], key[begins[y] : ends[y]]
        if not len(kx) or not len(ky):
            continue
        at = np.minimum(np.searchsorted(ky, kx), len(ky) - 1)
        both = ky[at] == kx
        common = np.minimum(weight[begins[x] : ends[x]][both], weight[begins[y] : ends[y]][at[both]]).sum()
        out[i] = 1 - common / (sums[x] + sums[y] - common)
    return out


def tokens(own: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sets whose similarity is the weighted one: a shingle of weight w is w tokens. In order, and where each text's end."""
    key, owner, weight = multisets(own, width)
    layers = weight.astype(np.int64)
    at = np.repeat(np.arange(len(key)), layers)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(layers) - layers, layers)
    token, owner = mixed(key[at] ^ (layer.astype(np.uint64) * _ODD)).view(np.int64), owner[at]
    return token[np.lexsort((token, owner))], np.cumsum(np.bincount(owner, minlength=len(own)))


def marks(own: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of tokens, and its mark (see ``links``)."""
    token, ends = tokens(own, width)
    sizes = np.diff(ends, prepend=0)
    place = np.repeat(np.arange(len(own)), sizes) * BITS + (token & (BITS - 1))
    odd = (np.bincount(place, minlength=len(own) * BITS) & 1).astype(np.uint8)
    return sizes, np.packbits(odd).view(np.int64).reshape(len(own), BITS // 64)


def first_tokens(leads: list[bytes], own: list[bytes], common: np.ndarray, similarity: float, width: int = WIDTH) -> tuple[pa.Array, pa.Array]:
    """For each text its number of tokens and the first ``links.room`` of them, last those in ``common``, in its
    order, and before them those that its leader has."""
    index: dict[bytes, int] = {}
    pairs = [(index.setdefault(x, len(index)), index.setdefault(y, len(index))) for x, y in zip(leads, own, strict=True)]
    token, ends = tokens(list(index), width)
    late = np.zeros(len(token), np.int64)
    if len(common):
        place = np.argsort(common)
        at = place[np.minimum(np.searchsorted(common, token, sorter=place), len(common) - 1)]
        late = np.where(common[at] == token, at + 2, 0)
    of = lambda x, i: x[ends[i - 1] if i else 0 : ends[i]]
    out, sizes = [], []
    for x, y in pairs:
        mine = of(token, y)
        rank = np.maximum(of(late, y), np.isin(mine, of(token, x), assume_unique=True))
        sizes.append(len(mine))
        out.append(mine[np.argsort(rank, kind="stable")][: len(mine) - int(np.ceil(len(mine) * similarity - 1e-9)) + 1])
    offsets = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
    return pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))


def _named(docs: DataFrame, similarity: float, bands: int, rows: int, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows' doc_id, h1, h2 and bands, and for each different text with words h1, h2, its smallest doc_id rep, and its class."""
    each = cut(signed(docs, bands, rows, width))
    items = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    members = items.where("bands is not null").select("item", "bands")

    texts_of: list[DataFrame] = []

    def held_texts(wanted: DataFrame) -> DataFrame:
        needed = wanted.join(items.select("item", "h1", "h2", "rep"), "item")
        source = _copies(docs)
        held = source.join(needed, (source["h1"] == needed["h1"]) & (source["h2"] == needed["h2"]) & source["doc_id"].eqNullSafe(needed["rep"])).select("item", "text")
        return cut(held.dropDuplicates(["item"]))

    def marked(wanted: DataFrame) -> DataFrame:
        texts_of.append(held_texts(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, most=SLICE):
                sizes, rows = marks(texts(s), width)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, BITS // 64), pa.int32()), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([s.column("item"), pa.array(sizes, pa.int32()), lists], names=["item", "weight", "mark"])

        return texts_of[0].select("item", "text").mapInArrow(run, "item long, weight int, mark array<long>")

    def verify(pairs: DataFrame) -> DataFrame:
        held = only(texts_of[0], pairs)
        both = pairs.join(held.select(F.col("item").alias("a"), F.col("text").alias("ta")), "a").join(held.select(F.col("item").alias("b"), F.col("text").alias("tb")), "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "tb", SLICE):
                yield pa.RecordBatch.from_arrays([s.column("a"), s.column("b"), pa.array(distance(s, width))], names=["a", "b", "d"])

        return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, d double")

    def sets(wanted: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, most=SLICE):
                found, ends = tokens(texts(s), width)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(found))
                yield pa.RecordBatch.from_arrays([s.column("item"), lists], names=["item", "tokens"])

        return wanted.join(texts_of[0], "item").select("item", "text").mapInArrow(run, "item long, tokens array<long>")

    def firsts(pairs: DataFrame, common: list[int]) -> DataFrame:
        late = np.array(common, np.int64)
        held = only(texts_of[0], pairs)
        both = pairs.join(held.select(F.col("item").alias("lead"), F.col("text").alias("ta")), "lead").join(held.withColumnRenamed("text", "tb"), "item")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches, "tb", SLICE):
                sizes, lists = first_tokens(texts(s, "ta"), texts(s, "tb"), late, similarity, width)
                yield pa.RecordBatch.from_arrays([s.column("lead"), s.column("item"), sizes, lists], names=["lead", "item", "size", "tokens"])

        return both.select("lead", "item", "ta", "tb").mapInArrow(run, "lead long, item long, size int, tokens array<long>")

    found = classes(members, verify, 1 - similarity + 1e-12, sets, firsts, marked)
    named = cut(items.join(found, items["item"] == found["node"], "left").where("bands is not null").select("h1", "h2", "rep", F.coalesce("component", "item").alias("class")))
    discard(items, found, *texts_of)
    return each, named


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the class of near duplicates) and kept (whether that is this one)."""
    each, named = _named(docs, similarity, bands, rows, width)
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    grouped = named.join(least, "class").select("h1", "h2", "component_id")
    alone = each.where("bands is null").select("doc_id", F.col("doc_id").alias("component_id"))
    out = each.where("bands is not null").join(grouped, ["h1", "h2"]).select("doc_id", "component_id").union(alone)
    return out.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each class, that of the smallest doc_id (null only if all are), and every row whose text has no words."""
    each, named = _named(docs, SIMILARITY, BANDS, ROWS, WIDTH)
    first = named.groupBy("class").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h1", "h2")).alias("m")).select("m.rep", F.col("m.h1").alias("f1"), F.col("m.h2").alias("f2"))
    rows = each.where("bands is not null").groupBy("doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    same = (rows["h1"] == first["f1"]) & (rows["h2"] == first["f2"]) & rows["doc_id"].eqNullSafe(first["rep"])
    # what goes, and what stays once of several rows
    held = cut(rows.join(first, same, "left").where("f1 is null or n > 1").select(F.col("doc_id").alias("of"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("f1").isNotNull().alias("stays")))
    text = F.coalesce(docs["text"], F.lit(""))
    h1, h2 = F.xxhash64(F.lit(1), text), F.xxhash64(text, F.lit(2))
    here = (h1 == held["g1"]) & (h2 == held["g2"]) & docs["doc_id"].eqNullSafe(held["of"])
    out = docs.join(held, here, "left_anti")
    once = held.where("stays")
    if once.isEmpty():
        return out
    repeated = docs.join(once, here, "left_semi").select(docs["doc_id"].alias("of"), h1.alias("g1"), h2.alias("g2"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    return out.union(repeated.groupBy("of", "g1", "g2").agg(F.first("row").alias("row")).select("row.*"))
