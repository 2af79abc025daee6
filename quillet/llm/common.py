"""What the operators share: words, batches by bytes, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.session import cut, discard

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 2 << 20
#: Rows of two numbers that a join may broadcast: 3 MB.
LIGHT = 200_000

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator works on, so that no other column's name can clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def parted(rows: DataFrame) -> DataFrame:
    """Adds part to rows (doc_id, text): 0, or a hash of the text where its doc_id comes with several different texts."""
    own = F.xxhash64(F.lit(3), "text")
    several = cut(rows.groupBy("doc_id").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("of"), F.lit(True).alias("several")))
    if several.isEmpty():
        return rows.withColumn("part", F.lit(0).cast("long"))
    return rows.join(several, rows["doc_id"].eqNullSafe(several["of"]), "left").select(*rows.columns, F.when(F.col("several"), own).otherwise(F.lit(0)).cast("long").alias("part"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, or one row where it alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts' UTF-8 bytes; a null is empty."""
    return [x if x is not None else b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def light(df: DataFrame, most: int = LIGHT) -> DataFrame:
    """For a join: a table of two numbers a row goes to all executors if its rows are counted and at most ``most``."""
    return F.broadcast(df) if df.count() <= most else df


def gathered(df: DataFrame, most: int = LIGHT) -> DataFrame:
    """A table whose rows are counted and at most ``most`` is worked on by one task, without shuffles."""
    return df.coalesce(1) if df.count() <= most else df


def components(edges: DataFrame) -> DataFrame:
    """Union-find over links (a, b): returns (node, component) for every node with a link, named by the smallest member.

    Each round hooks every node to the neighbour of least priority, if that is less than its own, and contracts the
    links. Priorities are the numbers themselves at first, as a bucket's leader is its smallest member, and then hashes
    salted by the round, so chains of any order shrink by a constant part each time. Only minima and joins are needed,
    no group is gathered, and every round is cut into the shared folder."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = cut(edges.where("a <> b").select(*ordered(F.col("a"), F.col("b"))))
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        rank = (lambda c: F.xxhash64(F.lit(len(hooks)), F.col(c))) if hooks else F.col
        near = gathered(links)
        ways = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")).select("w.a", "w.b")
        best = ways.groupBy("a").agg(F.min(rank("b")).alias("rank"), F.min_by("b", rank("b")).alias("to"))
        hooks.append(cut(best.select(F.col("a").alias("node"), F.when(F.col("rank") < rank("a"), F.col("to")).otherwise(F.col("a")).alias("to"))))
        step = light(hooks[-1])
        left, right = (step.select(F.col("node").alias(c), F.col("to").alias(f"{c}2")) for c in "ab")
        rest = cut(near.join(left, "a").join(right, "b").where("a2 <> b2").select(*ordered(F.col("a2"), F.col("b2"))).distinct())
        discard(links)
        links = rest
    if not hooks:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    held = hooks[0]
    for h in hooks[1:]:
        held = held.join(light(h).select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    held = cut(held)
    names = cut(gathered(held).groupBy("to").agg(F.min("node").alias("component")))
    out = cut(held.join(light(names), "to").select("node", "component"))
    discard(links, held, names, *hooks)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for later calls."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _POWERS[base] = held
    return held[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on each other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(own: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all words of the texts in order: a 64-bit hash of the word, and its text's index."""
    hashes, start, _ = word_spans(np.frombuffer(b" ".join(own), np.uint8))
    return hashes, np.searchsorted(np.cumsum([len(x) + 1 for x in own]), start, side="right")


def word_spans(data: np.ndarray, parts: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of each word of the bytes, where it starts and where it ends; words lie between bytes of ``parts``.

    For each length in ``prefixes``, the hash of the word's first bytes too (0 where it is no longer than that)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.uint64) for _ in prefixes]
    space = parts[data]
    edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    values = _BYTE[data]
    values *= powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    back = powers(_BACK, len(data))[start]
    heads = []
    for n in prefixes:
        long = end - start > n
        head = mixed((sums[np.where(long, start + n, start)] - sums[start]) * back + np.uint64(n))
        heads.append(np.where(long, head, np.uint64(0)))
    return mixed((sums[end] - sums[start]) * back), start, end, *heads


def kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One position of each different key, and for every key the index into those."""
    at, new = _sorted(keys)
    rank = np.empty(len(keys), np.int64)
    rank[at] = np.cumsum(new) - 1
    return at[new], rank


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of key, and which of them begin a new key. A plain sort of packed keys is far faster than an argsort."""
    bits = max(1, int(max(0, len(keys) - 1)).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64))
    at = (packed & low).astype(np.int64)
    new = np.concatenate([[True], keys[at][1:] != keys[at][:-1]])[: len(keys)]
    if (new[1:] & ((packed[1:] ^ packed[:-1]) <= low)).any():  # some agree in the upper bits only: sort by all of them
        at = np.argsort(keys, kind="stable")
        new = np.concatenate([[True], keys[at][1:] != keys[at][:-1]])[: len(keys)]
    return at, new


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions i, j of equal keys, each next to the other among its equals."""
    at, new = _sorted(keys)
    same = np.flatnonzero(~new)
    return at[same - 1], at[same]
