"""URL rules by a cascade of Bloom filters, exact over the corpus's own keys and without joins.

A rule is a host and a path prefix; it fits the host and its subdomains. Every url gives one candidate key for each
shape that rules have (how many labels, how long a path), so whether a rule fits is whether its key is listed. Level 0
holds the listed keys. Level 1 holds the corpus's other keys that level 0 wrongly admits, level 2 the listed keys that
level 1 admits, and so on until a level admits nothing wrong; for the complete universe of keys the parity of the
first level that denies a key is exact membership.

A null url, or one without ``://``, has an empty host and path and no rule. Copies of a url are judged alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.llm.common import pick
from quillet.session import cut

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The filters of a cascade are literals of the plan; beyond this many bytes it refuses, as they'd be no small constant.
MOST_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


@dataclass(frozen=True)
class Bloom:
    words: tuple[int, ...]  # 64 bits each, signed
    hashes: int
    salt: int

    @classmethod
    def positions(cls, key: Column, n_words: int, hashes: int, salt: int) -> list[Column]:
        a, b = F.xxhash64(F.lit(salt), key), F.xxhash64(key, F.lit(salt + 7919)).bitwiseOR(F.lit(1))
        return [F.pmod(_mixed(a, b, k), F.lit(64 * n_words)) for k in range(hashes)]

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, salt: int) -> Bloom:
        bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        n_words, hashes = -(-bits // 64), max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
        hashes = min(hashes, 16)
        if 8 * n_words > MOST_BYTES:
            raise ValueError(f"{n} keys need {8 * n_words} bytes; the bound is {MOST_BYTES}")
        spots = keys.select(F.explode(F.array(*cls.positions(F.col("key"), n_words, hashes, salt))).alias("bit"))
        mask = F.get(_masks(), (F.col("bit") % 64).cast("int"))
        rows = spots.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(mask).alias("bits")).collect()  # as many as the filter has words
        held = [0] * n_words
        for r in rows:
            held[r.word] = r.bits
        return cls(tuple(held), hashes, salt)

    def admits(self, key: Column) -> Column:
        held = _longs(self.words)
        out = F.lit(True)
        for bit in self.positions(key, len(self.words), self.hashes, self.salt):
            word = F.get(held, F.floor(bit / 64).cast("int"))
            out = out & (word.bitwiseAND(F.get(_masks(), (bit % 64).cast("int"))) != 0)
        return out


def _masks() -> Column:
    """1, 2, 4, ... as signed 64-bit numbers."""
    return _longs(tuple(1 << i if i < 63 else -(1 << 63) for i in range(64)))


def _longs(values: tuple[int, ...]) -> Column:
    """An array constant, folded once from one string instead of a literal for each value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _mixed(a: Column, b: Column, k: int) -> Column:
    """The k-th position from two hashes; mixed, as sums would overflow under ANSI rules."""
    return a if k == 0 else F.xxhash64(a, F.lit(k), b)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Bloom, ...]

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            out = F.when(self.levels[depth].admits(key), out).otherwise(F.lit(depth % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.01) -> Cascade:
    """``listed`` and ``universe`` have a column ``key``. The universe's keys are cut to those still admitted at each level."""
    listed = cut(listed.select("key").where("key is not null").distinct())
    n = listed.count()
    if not n:
        return Cascade(())
    first = Bloom.build(listed, n, rate, 1)
    # what level 0 wrongly admits, by the list itself; this is the build's only join, and of the filtered side
    others = cut(universe.select("key").where("key is not null").where(first.admits(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    levels, sides, depth = [first], [listed, others], 1
    while True:
        wrong = sides[depth % 2]
        if depth > 1:
            wrong = cut(wrong.where(levels[-1].admits(F.col("key"))))
            sides[depth % 2] = wrong
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        levels.append(Bloom.build(wrong, n, 0.5 if depth > 1 else rate, depth + 1))
        depth += 1


def parse_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict; ``default`` is the verdict where no rule is listed for the url.

    Of the rules that fit, the longest wins, at equal length the one with the longer host."""
    verdict_of = {r: v for v, r in rules}
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    shapes = sorted({(parse_rule(r)[0].count(".") + 1, len(parse_rule(r)[1])) for r in verdict_of})
    keys = []
    for labels, length in shapes:
        fits = (F.length("host") - F.length(F.translate("host", ".", "")) >= labels - 1) & (F.length("path") >= length)
        keys.append(F.when(fits, F.concat(F.substring_index("host", ".", -labels), F.substring(F.col("path"), 1, length))))
    if not keys:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    session = pages.sparkSession
    listed = session.createDataFrame([(r,) for r in verdict_of], "key string")
    universe = rows.select(F.explode(F.array(*keys)).alias("key")).where("key is not null").distinct()
    cascade = build_cascade(listed, universe)
    longest = F.array_sort(F.filter(F.array(*[F.when(cascade.holds(k), F.struct((-F.length(k)).alias("n"), (-F.length(F.substring_index(k, "/", 1))).alias("h"), k.alias("key"))) for k in keys]), lambda x: x.isNotNull()))
    rule = F.get(longest, F.lit(0))["key"]
    told = F.create_map(*[F.lit(x) for pair in verdict_of.items() for x in pair])
    return rows.select("*", rule.alias("rule")).select("*", F.coalesce(F.element_at(told, F.col("rule")), F.lit(default)).alias("verdict"))
