"""From candidate buckets to the links that matter, without all pairs of a bucket.

Every bucket first compares its members with one leader, and where much is left, with a second one, the member nearest
to the first. Buckets whose members are in one component then are done. In the others, members of different components
remain to be compared, if the triangle inequality by the leader allows a link. Where those pairs are few they are
compared directly, two by two. Where they are many, the bucket is split by tokens: all its members order their tokens
alike, rare ones that the leader lacks first, and keep the first few of them; two sets that are near enough share one of
these, whatever the order, so no link is lost, and what made the bucket large comes last. The parts are buckets like
others, with new leaders, and so on. After ``LEVELS`` levels what is
left is compared directly, so every pair of a bucket is compared, or in one component already, or too far apart.

Members may have marks: the size of the set, and for each of ``BITS`` hashed places whether an odd number of its tokens
falls there. A token that only one of two sets has changes one place, so no more places differ than there are such
tokens, and pairs where too many do are too far apart. They are left out before texts are fetched.

Distances are Jaccard distances of sets, or of multisets taken as sets of numbered tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.llm.common import components, gathered, light
from quillet.session import cut, discard

#: Buckets with more pairs to compare are split by tokens; how often at most. Steps of the greatest distance of a link.
MANY, LEVELS, STEPS = 4096, 2, 4
#: How many common tokens come last in the order of tokens.
COMMON = 4096
#: Of so many items one is looked at for large buckets; a bucket is large if more than so many of these are in it.
SAMPLE, LARGE = 64, 64
#: Places of a mark, 64 to a number.
BITS = 1024

Step = Callable[[DataFrame], DataFrame]


def room(size: Column, similarity: float) -> Column:
    """How many of its first tokens a set of this size keeps, so that near sets share one."""
    return (size - F.ceil(size * similarity - 1e-9) + 1).cast("int")


def classes(members: DataFrame, verify: Step, farthest: float, sets: Step, firsts: Callable[[DataFrame, list[int]], DataFrame], marked: Step | None = None) -> DataFrame:
    """(node, component) over members (item, bands) that have a link; a band is a number that names it and its content.
    If they are a table that ``cut`` made, it is discarded when the buckets are known.

    ``verify`` adds the distance d to pairs (a, b), or null where it is surely too far. ``sets`` adds tokens to items
    (item). ``firsts`` adds size and tokens to pairs (lead, item): how many tokens the item has, and the first ``room`` of
    them, where those in a given list come last and in its order, and before them those that the leader has. ``marked`` gets the items (item) that share a bucket, before any other step,
    and adds weight, the size of the set, and its mark."""
    spots = members.select("item", F.explode_outer(F.array_distinct("bands")).alias("bucket")).where("bucket is not null")
    found = direct = few = None
    held = _first_led(spots)
    discard(members)
    marks = None if marked is None else cut(marked(held.select("item").distinct()))
    for level in range(LEVELS + 1):
        pairs = held.where("apart").select(*_ordered("lead", "item"))
        pairs = pairs.distinct() if marks is None else _unmarked(pairs.distinct(), marks, farthest)
        for more in (direct, None if few is None else _direct(few, farthest, marks)):
            pairs = pairs if more is None else pairs.union(more)
        pairs = cut(pairs.distinct())
        seen = cut(verify(pairs))
        discard(pairs, direct, few)
        before, found = found, _merged(found, seen.where(F.col("d") <= farthest).select("a", "b"))
        if before is not found:
            discard(before)
        rows = _open(gathered(held), seen, light(found), farthest, level < LEVELS)
        discard(held, seen)
        near = gathered(rows)
        direct = cut(_direct(near if level == LEVELS else near.where(F.col("todo") <= MANY), farthest, marks))
        many = near.where(F.lit(level < LEVELS) & (F.col("todo") > MANY))
        if many.isEmpty():
            discard(rows)
            break
        if level == 0:
            held = _nearest_led(many)
        else:
            led = cut(_ordered_by(many))
            told = firsts(led.select("lead", "item"), _common(sets(many.select("item").distinct())))
            kept = cut(told.join(led, ["lead", "item"]).select("lead", "item", "class", "size", "tokens"))
            held, few = _led(kept, level, farthest)
            discard(led, kept)
        discard(rows)
    seen = None if direct.isEmpty() else cut(verify(direct))
    if seen is not None:
        found = _merged(found, seen.where(F.col("d") <= farthest).select("a", "b"))
    discard(direct, seen, marks)
    return found


def mark(token: str = "token") -> list[Column]:
    """The weight and mark of a set whose different tokens are the group's rows."""
    place = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(token).bitwiseAND(F.lit(63)).cast("int"))
    lane = F.col(token).bitwiseAND(F.lit(BITS - 1))
    longs = [F.coalesce(F.bit_xor(F.when(F.shiftright(lane, 6) == k, place)), F.lit(0).cast("long")) for k in range(BITS // 64)]
    return [F.count(F.lit(1)).cast("int").alias("weight"), F.array(*longs).alias("mark")]


def _may(x: str, y: str, farthest: float) -> Column:
    """Whether the marks let two sets be near."""
    apart = sum((F.bit_count(F.col(f"{x}mark")[k].bitwiseXOR(F.col(f"{y}mark")[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(f"{x}mark")[0].bitwiseXOR(F.col(f"{y}mark")[0])))
    u, v = F.col(f"{x}weight"), F.col(f"{y}weight")
    return F.greatest(apart, F.abs(u - v)) <= (u + v) * (farthest / (2 - farthest)) + 1e-9


def _unmarked(pairs: DataFrame, marks: DataFrame, farthest: float) -> DataFrame:
    """The pairs that may be near by their marks."""
    own = lambda c: marks.select(F.col("item").alias(c), F.col("weight").alias(f"{c}weight"), F.col("mark").alias(f"{c}mark"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where(_may("a", "b", farthest)).select("a", "b")


def only(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of rows of items those that pairs, a table of ``cut``, are made of. Where these are few, no shuffle sees the rest."""
    needed = pairs.select(F.explode(F.array(*pairs.columns[:2])).alias("item")).distinct()
    return held.join(light(needed), "item", "left_semi")


def _common(held: DataFrame) -> list[int]:
    """The tokens that most of these sets hold, ``COMMON`` at most, the rarest first. They set an order only: any list
    gives all links."""
    # an inner explode would make the tokens twice, to filter by their number
    counts = held.select(F.explode_outer("tokens").alias("token")).groupBy("token").agg(F.count("token").alias("n"))
    return [r.token for r in counts.where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON).collect()][::-1]


def _merged(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components with more links. Only the links between different ones are worked on."""
    if found is None:
        return components(links)
    known = light(found)
    name = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"{c}2"))
    named = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select("a", "b", F.coalesce("a2", "a").alias("a2"), F.coalesce("b2", "b").alias("b2")).where("a2 <> b2")
    named = cut(named)
    if named.isEmpty():
        discard(named)
        return found
    up = components(named.select(F.col("a2").alias("a"), F.col("b2").alias("b")))
    every = found.union(named.select("a", "a2").union(named.select("b", "b2"))).distinct()
    up_to = light(up).select(F.col("node").alias("component"), F.col("component").alias("up"))
    out = cut(every.join(up_to, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
    discard(named, up)
    return out


def _unplaced(*names: str) -> list[Column]:
    return [F.lit(None).cast("int").alias(c) for c in names]


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _first_led(spots: DataFrame) -> DataFrame:
    """Members of the buckets of several, with the bucket's leader, and whether they are apart from it, so that a
    comparison is of use. Most buckets hold one item, so one pass that lays members side by side costs half of counting
    them first and finding them again. Large buckets, known by a sample of the items, would be a single task's: these few
    are told their leader by a join instead."""
    large = cut(spots.where(F.pmod(F.xxhash64("item"), F.lit(SAMPLE)) == 0).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("bucket"))
    whole = Window.partitionBy("bucket")
    rest = spots if large.isEmpty() else spots.join(light(large), "bucket", "left_anti")
    rows = rest.select("bucket", "item", F.min("item").over(whole).alias("lead"), F.max("item").over(whole).alias("last")).where("lead <> last").drop("last")
    hot = shared = None
    if rest is not spots:
        hot = cut(spots.join(light(large), "bucket", "left_semi").select("bucket", "item"))
        shared = cut(hot.groupBy("bucket").agg(F.min("item").alias("lead")))
        rows = rows.union(hot.join(light(shared), "bucket").select("bucket", "item", "lead"))
    out = cut(rows.select("*", *_unplaced("pos", "size"), (F.col("item") != F.col("lead")).alias("apart")))
    discard(large, hot, shared)
    return out


def _nearest_led(many: DataFrame) -> DataFrame:
    """The same buckets, led by the member nearest to the first leader: in a group of near copies that tends to be the
    middle, which all others are near to."""
    rank = F.coalesce("d", F.lit(2.0))
    nearest = many.where("item <> lead").groupBy("bucket").agg(F.min_by("item", rank).alias("next"), F.min_by("class", rank).alias("next_class"))
    rows = many.join(nearest, "bucket")
    return cut(rows.select("bucket", "item", "pos", "size", F.col("next").alias("lead"), (F.col("class") != F.col("next_class")).alias("apart")))


def _short(farthest: float) -> Column:
    """Whether the smaller of two near sets can have its first common token at this place. Of any two one must."""
    return F.coalesce(F.col("pos") <= F.col("size") * (farthest / (2 - farthest)) + 1e-9, F.lit(True))


def _enough(x: str, y: str, farthest: float) -> Column:
    """The first token that two sets share leaves room for as many as they must share."""
    left = F.least(F.col(f"{x}size") - F.col(f"{x}pos"), F.col(f"{y}size") - F.col(f"{y}pos"))
    return F.coalesce(left >= (1 - farthest) / (2 - farthest) * (F.col(f"{x}size") + F.col(f"{y}size")) - 1e-9, F.lit(True))


def _ordered_by(many: DataFrame) -> DataFrame:
    """Members (item, class) of buckets to split, but for the buckets' leaders, which are compared, and the item that sets
    their order of tokens (lead). Buckets of one main component have one order, so a member of many of them is split once."""
    most = many.groupBy("main", "lead").agg(F.count(F.lit(1)).alias("n")).groupBy("main").agg(F.max_by("lead", F.struct("n", "lead")).alias("order"))
    return many.where("item <> lead").join(most, "main").select(F.col("order").alias("lead"), "item", "class").distinct()


def _led(kept: DataFrame, level: int, farthest: float) -> tuple[DataFrame, DataFrame]:
    """Members of the buckets that tokens of sets (kept) make and that hold several components, with a leader; and apart
    from these, members of buckets with few pairs, which are to be compared directly.

    One pass over the tokens says all of a bucket: nothing else is done with those of one component."""
    named = kept.select("lead", "item", "class", "size", F.posexplode("tokens").alias("pos", "token")).select(F.xxhash64("lead", "token").alias("bucket"), "item", "class", "pos", "size")
    rank = F.xxhash64(F.lit(level), "item")
    told = _several(named, farthest, F.min(F.struct(rank.alias("rank"), F.col("item").alias("lead"), F.col("class").alias("lead_class"), F.col("pos").alias("lead_pos"), F.col("size").alias("lead_size"))))
    rows = named.join(told.select("bucket", "main", "todo", "first.*").drop("rank"), "bucket")
    rows = cut(rows.withColumn("apart", (F.col("class") != F.col("lead_class")) & _enough("", "lead_", farthest)).drop("lead_class", "lead_pos", "lead_size"))
    few = cut(rows.where(F.col("todo") <= MANY).withColumns({"d": F.lit(None).cast("double"), "lead": F.lit(None).cast("long")}))
    held = cut(rows.where(F.col("todo") > MANY).drop("class", "main", "todo"))
    discard(rows)
    return held, few


def _several(named: DataFrame, farthest: float, first: Column | None = None) -> DataFrame:
    """Buckets that hold several components (class): the largest (main) and how many pairs are of different ones (todo);
    and the least of members' structs (first)."""
    own = [] if first is None else [first.alias("first")]
    each = named.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"), F.count_if(_short(farthest)).alias("shorts"), *own)
    least = [F.min("first").alias("first")] if own else []
    several = each.groupBy("bucket").agg(F.max_by("class", "n").alias("main"), F.sum("n").alias("n"), F.sum("shorts").alias("shorts"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("classes"), *least).where("classes > 1 and shorts > 0")
    return several.select("bucket", "main", F.least((F.col("n") * F.col("n") - F.col("squares")) / 2, F.col("shorts") * F.col("n")).alias("todo"), *(["first"] if own else []))


def _open(held: DataFrame, seen: DataFrame, found: DataFrame, farthest: float, bounded: bool) -> DataFrame:
    """Members of buckets that hold several components beside the leader, with the distance d to it and the component
    (class). The leader has been compared with all others and is none of them: in a bucket of two nothing is left to do.

    How many pairs there are to compare (todo) is bounded by counts of members in steps of d as well, since pairs whose
    distances to the leader differ by too much are none. Where all are compared directly, nothing asks for that bound."""
    known = seen.select(F.col("a").alias("u"), F.col("b").alias("v"), "d")
    held = held.where("item <> lead")
    rows = held.join(found, held["item"] == found["node"], "left").select("bucket", "item", "lead", "pos", "size", "apart", F.coalesce("component", "item").alias("class"))
    held = cut(rows.join(_several(rows, farthest), "bucket"))
    # only those that were compared have a distance to look up
    compared = held.where("apart").drop("apart").withColumns({"u": F.least("lead", "item"), "v": F.greatest("lead", "item")}).join(known, ["u", "v"], "left").drop("u", "v")
    rows = cut(compared.unionByName(held.where("not apart").drop("apart").withColumn("d", F.lit(None).cast("double"))))
    discard(held)
    if not bounded:
        return rows
    known = gathered(rows)
    step = F.floor(F.col("d") / (farthest / STEPS)).cast("int")
    each = known.groupBy("bucket", step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class") != F.col("main")).alias("others"))
    whole = Window.partitionBy("bucket")
    beside = F.sum("n").over(whole.orderBy("step").rangeBetween(-STEPS - 1, STEPS + 1)) + F.coalesce(F.sum(F.when(F.col("step").isNull(), F.col("n"))).over(whole), F.lit(0))
    near = each.select("bucket", (F.col("others") * F.when(F.col("step").isNull(), F.sum("n").over(whole)).otherwise(beside)).alias("pairs"))
    bound = near.groupBy("bucket").agg(F.sum("pairs").alias("bound"))
    out = cut(known.join(bound, "bucket").withColumn("todo", F.least("todo", "bound")).drop("bound"))
    discard(rows)
    return out


def _direct(rows: DataFrame, farthest: float, marks: DataFrame | None) -> DataFrame:
    """Pairs of different components in a bucket that may be near enough. A leader has been compared already."""
    rows = rows.where("lead is null or item <> lead")
    may = F.lit(True)
    if marks is not None:
        rows, may = rows.join(marks, "item"), _may("x.", "y.", farthest)
    x, y = rows.where("class <> main").alias("x"), rows.alias("y")
    once = (F.col("y.class") == F.col("y.main")) | (F.col("x.item") < F.col("y.item"))
    near = F.coalesce(F.abs(F.col("x.d") - F.col("y.d")) <= farthest, F.lit(True))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.class") != F.col("y.class")) & once & near & _enough("x.", "y.", farthest) & may)
    return pairs.select(*_ordered("x.item", "y.item")).distinct()
