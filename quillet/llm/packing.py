"""Best-fit packing of documents into token sequences, with Martello-Toth dominance reduction first.

Lengths lie between 1 and the capacity, so the whole instance is a histogram of at most ``capacity`` counts, whatever
the number of documents. Reduction and best fit run on it: sets of equal make are fixed or filled by the number at once.
The result is a list of slots (length, first rank, count, first sequence, offset); every piece finds its slot by its
rank among the pieces of its length. Ranks come from hash groups whose sizes are summed first, so that a length that
many pieces share is nobody's single task.

A null or empty text is one closing id. Documents with the same id and text are separate.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import pick, slices
from quillet.llm.wordbpe import WordBpe
from quillet.session import cut

CAPACITY = 2048


@dataclass(frozen=True)
class Shape:
    """``count`` sequences that hold these lengths in this order."""

    lengths: tuple[int, ...]
    count: int


def _largest_at_most(sizes: list[int], limit: int) -> int | None:
    i = int(np.searchsorted(sizes, limit, side="right"))
    return sizes[i - 1] if i else None


def reduce_dominated(counts: Counter[int], capacity: int) -> list[Shape]:
    """Fixes sets that dominate every other set their largest item can be in, and takes them out of ``counts``.

    For the largest remaining length j, let k be how many of the smallest others fit beside it. With k = 0 it stands
    alone. With k = 1, or when the best single partner fills the sequence, that partner dominates. With k = 2 the best
    partner dominates if it is at least as long as the best pair together. Other lengths wait, and j goes on downwards."""
    fixed: list[Shape] = []
    again = True
    while again:
        again = False
        for j in sorted(counts, reverse=True):
            n = counts.get(j, 0)
            while n:
                room = capacity - j
                sizes = sorted(k for k, v in counts.items() if v - (k == j) > 0)
                partner = _largest_at_most(sizes, room) if sizes else None
                if partner is None:
                    chosen: tuple[int, ...] | None = (j,)
                else:
                    low = _smallest(counts, j, 3)
                    if j + partner == capacity or len(low) < 2 or low[0] + low[1] > room:
                        chosen = (j, partner)
                    elif (len(low) < 3 or sum(low) > room) and partner >= _best_pair(counts, j, sizes, room):
                        chosen = (j, partner)
                    else:
                        chosen = None
                if chosen is None:
                    break
                times = n // 2 if chosen == (j, j) else n if len(chosen) == 1 else min(n, counts[chosen[1]])
                if len(chosen) == 2 and j + partner != capacity:
                    times = min(times, 1) if chosen == (j, j) else times
                for length in chosen:
                    counts[length] -= times
                    if not counts[length]:
                        del counts[length]
                fixed.append(Shape(chosen, times))
                n, again = counts.get(j, 0), True
    return fixed


def _smallest(counts: Counter[int], without: int, n: int) -> list[int]:
    out: list[int] = []
    for k in sorted(counts):
        out += [k] * min(n, counts[k] - (k == without))
        if len(out) >= n:
            return out[:n]
    return out


def _best_pair(counts: Counter[int], without: int, sizes: list[int], room: int) -> int:
    """The most that two other items fill of the room, or 0."""
    best, i, j = 0, 0, len(sizes) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total > room or i == j and counts[sizes[i]] - (sizes[i] == without) < 2:
            j -= 1
        else:
            best, i = max(best, total), i + 1
    return best


def best_fit(counts: Counter[int], capacity: int) -> list[Shape]:
    """Best fit of the lengths in decreasing order, by the number: open sequences are kept by their room."""
    rooms: dict[int, list[Shape]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                held, room = Shape((), n), capacity  # as many new ones as could be needed
            else:
                held = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
            each = room // length
            full = min(held.count, n // each)
            parts = [(full, each)]
            if full < held.count and n - full * each:
                parts.append((1, n - full * each))
            for times, items in parts:
                if times:
                    rooms.setdefault(room - items * length, []).append(Shape(held.lengths + (length,) * items, times))
                    n -= times * items
            left = held.count - sum(t for t, _ in parts)
            if left and held.lengths:
                rooms.setdefault(room, []).append(Shape(held.lengths, left))
    return [s for shapes in rooms.values() for s in shapes]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Shape]:
    counts = Counter({int(k): int(v) for k, v in histogram.items() if v})
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(shapes: list[Shape]) -> pd.DataFrame:
    """For each length, which ranks go to which sequences, and where in them; sorted by length and rank."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for shape in shapes:
        offset = 0
        for length in shape.lengths:
            rows.append((length, taken[length], shape.count, sequence, offset))
            taken[length] += shape.count
            offset += length
        sequence += shape.count
    return pd.DataFrame(rows, columns=["length", "rank", "count", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, closing: int = 0) -> DataFrame:
    """Each document's ids and a closing id, in pieces of at most ``capacity``, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe.of(vocabulary)
        for b in slices(batches):
            ids, out = b.column("doc_id").to_pylist(), []
            for doc_id, own in zip(ids, bpe.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                own = np.append(own, np.uint32(closing)).astype("<u4")
                for start in range(0, len(own), capacity):
                    part = own[start : start + capacity]
                    out.append((doc_id, start // capacity, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64", "piece": "int32"}), preserve_index=False)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, groups: int = 256) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece has its place, sequences have no gaps."""
    rows = cut(pieces(docs, vocabulary, capacity))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    counted = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = cut(counted.select("length", "part", "n", ahead.alias("ahead")))  # capacity x groups rows at most
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(solve(histogram, capacity))
    key = (table["length"].to_numpy(np.int64) << 44) + table["rank"].to_numpy(np.int64)
    first, sequence, offset = (table[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = f.pop("rank").to_numpy(np.int64)
            at = np.searchsorted(key, (f["length"].to_numpy(np.int64) << 44) + rank, side="right") - 1
            yield f.assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    order = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.select("*", order.alias("place")).join(counted.drop("n"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("place")).alias("rank"))
    return ranked.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

