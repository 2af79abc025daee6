"""Mixing sources to target weights by systematic sampling.

Sources in code-point order (null last) take the weights in turn and share all words; a target stops at ``most`` times
its source's words, and what is over goes to the others by weight. Within a source every document expects
target / words copies. Their prefix sum runs over the documents in order of size, one random offset is added for the
source, and a document is taken once for each whole number its own stretch crosses. In order of size the words taken
stay within about one longest document of the target.

A null or empty text has size 0 and is placed like any other, a very long one too: it is taken whole or not at all. Rows
that repeat, or share an id, are separate documents. An empty table gives an empty mix. Other columns pass through
``emit``, whatever their names. All random
numbers are hashes of ``seed``, the source and the row, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import WORD, pick
from quillet.session import cut

WEIGHTS = (5, 2, 1)
MOST = 3


def sizes(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so windows over all of them are short.

    Capped sources are those of least cap per weight, so a prefix of that order is capped and the rest share by weight."""
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights)).cast("int") + 1)
    rows = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("used"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
        F.sum("source_size").over(everything).cast("double").alias("all"),
    )
    # if this source and all of greater cap per weight share what the capped ones before left, is it above its cap?
    level = (F.col("all") - F.col("used")) / F.col("open")
    rows = rows.withColumn("over", level * F.col("weight") > F.col("cap"))
    free = F.min(F.when(~F.col("over"), F.struct((F.col("cap") / F.col("weight")).alias("o"), level.alias("level")))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(F.col("over"), F.col("cap")).otherwise(F.least(F.coalesce(free, F.lit(0.0)) * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, ties: int = 512, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies x size) for every document, and the
    columns in ``also``.

    Documents of one source and size are ordered in ``ties`` separate hash groups, whose lengths are summed first: no
    task orders a whole source, and equal sizes, however many, spread over the groups."""
    rows = cut(pick(docs, "doc_id", "source", "text", *also).select(*also, "doc_id", "source", sizes(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("tie")))
    rows = rows.withColumn("part", F.pmod(F.col("tie"), F.lit(ties)))
    goal = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    groups = rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    # prefix sums in two steps, sizes within the source and groups within the size
    by_size = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    under = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.select(F.col("source").alias("s"), F.col("size").alias("z"), under.alias("under"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("source", "size", "part", within.alias("within"))
    groups = groups.join(by_size, groups.source.eqNullSafe(by_size.s) & (F.col("size") == F.col("z"))).select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("part").alias("p"), (F.col("under") + F.col("within")).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("tie", "doc_id"))
    rows = rows.select("*", place.alias("place"))
    rows = rows.join(groups, rows.source.eqNullSafe(groups.s) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p"))).select(*also, "doc_id", "source", "size", (F.col("ahead") + F.col("place")).alias("rank"))
    goal = goal.withColumnRenamed("source", "s")
    rows = rows.join(goal, rows.source.eqNullSafe(F.col("s")))
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(each * F.col("rank") + offset) - F.floor(each * (F.col("rank") - 1) + offset)
    copies = F.least(F.greatest(crossed, F.lit(0)), F.lit(most)).cast("long")
    return rows.select(*also, "doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11) -> DataFrame:
    """The mix itself: each row as often as it is taken. Rows are numbered first, so ids may repeat or be null."""
    row, times, copy = (fresh(docs, name) for name in ("row", "times", "copy"))
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mix(rows, weights, most, seed, also=(row,)).where("copies > 0").select(row, F.col("copies").alias(times))
    out = rows.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the table doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
