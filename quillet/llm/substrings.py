"""Removal of repeated 50-byte strings across documents.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id. Documents
with equal texts are settled first. In the others, anchors are the positions of least hash among the grams of a string:
every string of the length holds one, and equal strings hold the same. Only anchors found in several documents matter.
Around each of those, every string that holds the anchor lies in a short context; contexts are gathered by anchor, and
the strings' prefix polynomial hashes are compared in sorted order, with the bytes verified where they are equal.

Groups of anchors are dealt by hash into as many buckets as the bytes need, so tasks stay of one size; a passage that
many documents share spreads over its anchors. Where a text repeats itself in short periods, all its anchors are one:
neighbours with the same context are a run, which is compared once. Equal contexts are compared once, too. A null text is empty. Rows that repeat a doc_id are one document and
don't count against each other, but each of its texts, told apart by a part, loses what is found in it alone; a null
doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import kinds, mixed, parted, pick, powers, slices, texts
from quillet.session import cut, discard

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM  # how far a string that holds an anchor can start before it
CONTEXT = REACH + LENGTH
_B = 0x5851F42D4C957F2D
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64))  # of each byte, in polynomials
BUCKET_BYTES = 4 << 20
_FIRST = -(1 << 63)  # a null doc_id in comparisons


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` bytes, by prefix sums of a polynomial modulo 2**64."""
    values = mixed(data.astype(np.uint64) + np.uint64(1)) * powers(_B, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mixed((sums[n:] - sums[:-n]) * powers(pow(_B, -1, 1 << 64), len(data) - n + 1))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some string of the length; of equals the first."""
    if len(text) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _gram_hashes(np.frombuffer(text, np.uint8), GRAM)
    low, width = h.copy(), 1
    while 2 * width <= REACH + 1:  # minima of doubling windows
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        low = np.minimum(low[: len(low) - rest], low[rest:])
    # a gram is an anchor if it is the least of some window that holds it; equal grams at other places are too
    top, width = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)]), 1
    while 2 * width <= REACH + 1:
        top = np.maximum(top[:-width], top[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        top = np.maximum(top[: len(top) - rest], top[rest:])
    at = np.flatnonzero(top == h)
    return at, h[at]


def joined(text: bytes, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First positions, hashes and last positions of runs of anchors: neighbours of one hash with the same bytes around.

    Neighbours are less than a string's length apart, so the spans of a run's members are one, and what holds for the
    first holds for all."""
    near = np.flatnonzero((h[1:] == h[:-1]) & (at[:-1] >= REACH) & (at[1:] + LENGTH <= len(text)))
    if not len(near):
        return at, h, at
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), CONTEXT)
    first = np.ones(len(at), bool)
    for k in range(0, len(near), 4096):
        i = near[k : k + 4096]
        first[i + 1] = (view[at[i] - REACH] != view[at[i + 1] - REACH]).any(axis=1)
    return at[first], h[first], at[np.append(np.flatnonzero(first)[1:], len(at)) - 1]


def _buckets(total: int, spark) -> int:  # noqa: ANN001
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES + 1)


def _pack(docs: np.ndarray, parts: np.ndarray, grams: np.ndarray, at: np.ndarray, more: np.ndarray) -> bytes:
    """Occurrences in few bytes: they are sorted by document, so what repeats or grows slowly deflates well."""
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (parts[1:] != parts[:-1])])
    known, own, index = docs[new], parts[new], np.cumsum(new) - 1
    planes = lambda x: x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    rest = zlib.compress(np.diff(known, prepend=0).astype("<i8").tobytes() + own.astype("<i8").tobytes() + planes(np.diff(index, prepend=0)) + planes(at) + planes(more), 1)
    return np.array([len(known), len(at)], "<u4").tobytes() + grams.astype("<u4").tobytes() + rest


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n_docs, n = np.frombuffer(raw, "<u4", 2).tolist()
    grams = np.frombuffer(raw, "<u4", n, 8)
    rest = zlib.decompress(raw[8 + 4 * n :])
    known, own = np.cumsum(np.frombuffer(rest, "<i8", n_docs)), np.frombuffer(rest, "<i8", n_docs, 8 * n_docs)
    whole = lambda k: np.frombuffer(rest, np.uint8, 4 * n, 16 * n_docs + 4 * n * k).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)
    index = np.cumsum(whole(0))
    return known[index], own[index], grams, whole(1), whole(2)


def _deflated(docs: DataFrame) -> DataFrame:
    """doc, part and its text deflated, as whole texts are about to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("part"), pa.array([zlib.compress(t, 6) for t in texts(b)], pa.binary())], names=["doc", "part", "deflated"])

    return docs.select("doc", "part", "text").mapInArrow(run, "doc long, part long, deflated binary")


def covered(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(doc, part, spans): the spans [start, end) to remove from texts whose doc and part aren't in ``copies``; docs are ordered by number."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = _buckets(total, spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [(doc, *joined(text, *anchors(text)), part) for doc, part, text in sorted(zip(b.column("doc").to_pylist(), b.column("part").to_pylist(), texts(b), strict=True))]
            found = [f for f in found if len(f[1])]
            if not found:
                continue
            of = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
            part = np.repeat(np.array([f[4] for f in found], np.int64), [len(f[1]) for f in found])
            at, h, last = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
            bucket = (h % np.uint64(n)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, of, part, at, h, more = bucket[order], of[order], part[order], at[order], (h >> np.uint64(32))[order], (last - at)[order]
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
            packed = [_pack(of[i:j], part[i:j], h[i:j], at[i:j], more[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    def several(f: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in f["packed"]]
        d, part, a, at, more = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((d, a))
        d, part, a, at, more = d[order], part[order], a[order], at[order], more[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        size = np.diff(np.append(first, len(a)))
        keep = np.repeat(d[first] != d[first + size - 1], size)
        return pd.DataFrame({"bucket": f["bucket"].iloc[0], "anchor": a[keep].astype(np.int64), "doc": d[keep], "part": part[keep], "pos": at[keep], "more": more[keep]})

    spots = cut(docs.select("doc", "part", "text").mapInArrow(find, "bucket long, packed binary").groupBy("bucket").applyInPandas(several, "bucket long, anchor long, doc long, part long, pos long, more long"))
    places = spots.groupBy("doc", "part").agg(F.collect_list(F.struct("bucket", "anchor", "pos", "more")).alias("places")).join(copies, ["doc", "part"], "left_anti")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "deflated"):
            held = [(doc, part, text, own.values) for doc, part, text, own in zip(b.column("doc").to_pylist(), b.column("part").to_pylist(), map(zlib.decompress, texts(b, "deflated")), b.column("places"), strict=True)]
            if not held:
                continue
            get = lambda name: np.concatenate([p.field(name).to_numpy(zero_copy_only=False) for *_, p in held])  # noqa: B023, E731
            sizes = [len(p) for *_, p in held]
            bucket, pos = get("bucket"), get("pos")
            length = np.repeat([len(text) for *_, text, _ in held], sizes)
            numbers = np.stack([get("anchor"), np.repeat(np.array([doc for doc, *_ in held], np.int64), sizes), np.repeat(np.array([part for _, part, *_ in held], np.int64), sizes), pos, get("more"), np.minimum(pos, REACH), np.minimum(length - pos, LENGTH)]).astype("<i8")
            views = []
            for *_, text, p in held:
                padded = np.frombuffer(b"\0" * REACH + text + b"\0" * LENGTH, np.uint8)
                views.append(np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[p.field("pos").to_numpy(zero_copy_only=False)])
            view = np.concatenate(views)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
            packed = [zlib.compress(numbers[:, order[i:j]].tobytes() + view[order[i:j]].tobytes(), 1) for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[edges[:-1]]]), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    around = places.join(_deflated(docs), ["doc", "part"]).select("doc", "part", "deflated", "places").mapInArrow(context, "bucket long, packed binary")
    spans = around.groupBy("bucket").applyInPandas(earlier, "doc long, part long, start long, end long")
    out = cut(spans.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    discard(spots)
    return out


def _contexts(keys: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each different context, and for every place the index into those. keys: numbers that count as well."""
    wide = np.zeros((len(bytes_), -(-CONTEXT // 8) * 8), np.uint8)
    wide[:, :CONTEXT] = bytes_
    wide = wide.view("<u8")
    h = np.zeros(len(wide), np.uint64)
    for k in (*wide.T, *keys.view(np.uint64)):
        h = mixed(h * np.uint64(_B) ^ k)
    place, rank = kinds(h)
    lead = place[rank]
    alien = (wide != wide[lead]).any(axis=1) | (keys != keys[:, lead]).any(axis=0)  # of another context by chance
    return np.append(place, np.flatnonzero(alien)), np.where(alien, len(place) + np.cumsum(alien) - 1, rank)


def earlier(f: pd.DataFrame) -> pd.DataFrame:
    """For each run of a shared anchor, the span of its strings that an earlier document holds too."""
    raw = [zlib.decompress(x) for x in f["packed"]]
    each = [len(x) // (56 + CONTEXT) for x in raw]
    anchor, doc, part, pos, more, before, after = np.concatenate([np.frombuffer(x, "<i8", 7 * n).reshape(7, n) for x, n in zip(raw, each, strict=True)], axis=1)
    bytes_ = np.concatenate([np.frombuffer(x, np.uint8, -1, 56 * n).reshape(n, CONTEXT) for x, n in zip(raw, each, strict=True)])
    del raw
    place, of = _contexts(np.stack([anchor, before, after]), bytes_)
    low = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(low, of, doc)
    order = np.argsort(low, kind="stable")  # of equal strings, the first context has the first document
    rank = np.empty(len(place), np.int64)
    rank[order] = np.arange(len(place))
    place, low, of = place[order], low[order], rank[of]
    anchor, before, after, bytes_ = anchor[place].view(np.uint64), before[place], after[place], bytes_[place]
    across = np.ascontiguousarray(bytes_.T)
    power, back = powers(_B, CONTEXT), powers(pow(_B, -1, 1 << 64), CONTEXT)
    term = lambda k: _VALUE[across[k]] * power[k]
    total = np.zeros(len(place), np.uint64)
    for k in range(REACH, REACH + LENGTH):
        total += term(k)
    start, end = np.full(len(doc), -1, np.int64), np.full(len(doc), -1, np.int64)
    for a in range(REACH + 1):  # strings that start ``a`` bytes before the anchor
        at = REACH - a
        if a:
            total += term(at) - term(at + LENGTH)
        who = np.flatnonzero((before >= a) & (after >= LENGTH - a))
        if not len(who):
            continue
        new, own = kinds(mixed(total[who] * back[at] ^ anchor[who]))
        lead = who[new[own]]
        other = np.flatnonzero(lead != who)
        same = lead == who
        for k in range(0, len(other), 4096):
            i = other[k : k + 4096]
            same[i] = (bytes_[who[i], at : at + LENGTH] == bytes_[lead[i], at : at + LENGTH]).all(axis=1)
        first = np.full(len(place), np.iinfo(np.int64).max)  # document of each context's string
        first[who[same]] = low[lead[same]]
        hit = np.flatnonzero(first[of] < doc)
        end[hit] = np.where(end[hit] < 0, pos[hit] + more[hit] - a + LENGTH, end[hit])
        start[hit] = pos[hit] - a
    got = end >= 0
    return pd.DataFrame({"doc": doc[got], "part": part[got], "start": start[got], "end": end[got]})


def remove(text: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of the text, and how many separate runs went."""
    gone = np.zeros(len(text) + 2, np.int64)
    np.add.at(gone, spans[:, 0] + 1, 1)
    np.add.at(gone, spans[:, 1] + 1, -1)
    off = np.cumsum(gone)[1:-1] > 0
    runs = int(np.count_nonzero(off[1:] & ~off[:-1]) + (len(off) > 0 and off[0]))
    return np.frombuffer(text, np.uint8)[~off].tobytes(), runs


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = parted(pick(docs, "doc_id", "text").select("doc_id", text.alias("text")))
    rows = rows.select(F.coalesce("doc_id", F.lit(_FIRST)).alias("doc"), "part", "text")
    names = rows.select("doc", "part", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64("text", F.lit(2)).alias("h2"))
    copies = cut(names.join(names.groupBy("h1", "h2").agg(F.min("doc").alias("first")), ["h1", "h2"]).where("doc > first").select("doc", "part").distinct())
    spans = covered(rows, copies)
    fates = spans.select("doc", "part", "spans", F.lit(False).alias("copy")).union(copies.select("doc", "part", F.lit(None).cast(spans.schema["spans"].dataType), F.lit(True)))
    # a null doc_id is the number _FIRST and goes back to null
    joined = _deflated(rows).join(fates, ["doc", "part"], "left").select(F.when(F.col("doc") != _FIRST, F.col("doc")).alias("doc_id"), "deflated", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "deflated"):
            out = []
            for doc_id, own, copy, held in zip(b.column("doc_id").to_pylist(), map(zlib.decompress, texts(b, "deflated")), b.column("copy").to_pylist(), b.column("spans"), strict=True):
                if copy:
                    cover = np.array([[0, len(own)]] if len(own) >= LENGTH else np.zeros((0, 2)), np.int64).reshape(-1, 2)
                elif held.is_valid:
                    cover = np.stack([held.values.field("start").to_numpy(), held.values.field("end").to_numpy()], axis=1)
                else:
                    cover = np.zeros((0, 2), np.int64)
                kept, runs = remove(own, cover)
                out.append((doc_id, len(own), len(own) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
