"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, native expressions only.

Sources get target sizes by weight, capped at a multiple of their own size; the total is cut into equal blocks,
which go to the sources, and inside a source to its shards, by highest quotients v / (2 s + 1). Inside a shard the
documents lie on a line in seeded order and a seeded, cyclic run of blocks is taken, so one pass and two sums
per document tell how much of it the mix takes; no block is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, size, h): words of the whole text (null: 0) and a seeded place in the order."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", n.alias("size"), F.conv(F.substring(key, 1, 12), 16, 10).cast("long").alias("h"))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size) plus weight and target.

    Targets are min(most * size, level * weight) with the level at which they add up to `share` of all sizes: the
    fixed point of capping and resharing the excess. One row per source, so windows over all of them are small.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    filled = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    rows = rows.withColumns(
        {
            "total": total,
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # The level that holds if this source is the first that is not capped. It is over the source's own level for sources
    # before the right one, and falls after it, so the right one is the largest that its source bears.
    rows = rows.withColumn("try", (F.col("total") - F.col("capped")) / F.col("rest"))
    level = F.max(F.when(F.col("try") <= F.col("level"), F.col("try"))).over(every)
    return rows.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select(
        "source", "source_size", "weight", "target"
    )


def _null_safe(a: list[str], b: list[str]) -> Column:
    on = F.lit(True)
    for x, y in zip(a, b, strict=True):
        on = on & F.col(x).eqNullSafe(F.col(y))
    return on


def _winners(ranked: DataFrame, group: list[str], key: list[str], most: int) -> DataFrame:
    """The rows of each group with the `open` highest q, ties by key.

    Groups of over `most` rows are not sorted as a whole: counts in 256 equal steps narrow the range of q that holds the
    last winner, for all groups at once, until `most` rows or one value are left in each.
    """
    sizes = ranked.groupBy(*group).agg(F.max("open").alias("want"), F.min("q").alias("lo"), F.max("q").alias("hi"), F.count(F.lit(1)).alias("inside"))
    names = [f"g_{c}" for c in group]
    state = save(sizes.withColumnsRenamed(dict(zip(group, names, strict=True))).withColumn("above", F.lit(0).cast("long")), "state")

    def wide(s: DataFrame) -> DataFrame:
        return s.where((F.col("inside") > most) & (F.col("hi") > F.col("lo")))

    while not wide(state).isEmpty():
        own = ranked.join(wide(state), _null_safe(group, names)).where(F.col("q").between(F.col("lo"), F.col("hi")))
        step = F.least(F.floor((F.col("q") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 256), F.lit(255))
        bins = own.groupBy(*names, "want", "above", step.alias("bin")).agg(F.min("q").alias("lo"), F.max("q").alias("hi"), F.count(F.lit(1)).alias("inside"))
        higher = Window.partitionBy(*names).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("above", F.col("above") + F.coalesce(F.sum("inside").over(higher), F.lit(0)))
        here = bins.where((F.col("above") < F.col("want")) & (F.col("above") + F.col("inside") >= F.col("want")))
        # Where fewer rows are left than wanted all of them win; the lowest bin stands for that.
        lowest = F.row_number().over(Window.partitionBy(*names).orderBy("bin")) == 1
        short = bins.withColumn("last", lowest).where(F.col("last") & (F.col("above") + F.col("inside") < F.col("want"))).drop("last")
        narrow = here.unionByName(short).select(*state.columns)
        state = save(state.where((F.col("inside") <= most) | (F.col("hi") <= F.col("lo"))).unionByName(narrow), "state")
    placed = ranked.join(state, _null_safe(group, names)).where(F.col("q") >= F.col("lo"))
    order = Window.partitionBy(*group).orderBy(F.desc("q"), *[F.col(k).asc_nulls_last() for k in key])
    edge = placed.where(F.col("q") <= F.col("hi")).withColumn("r", F.row_number().over(order)).where(F.col("above") + F.col("r") <= F.col("want"))
    return placed.where(F.col("q") > F.col("hi")).select(*key).unionByName(edge.select(*key))


#: Ranked seats of a group that one task may sort.
SORTED = 1 << 17


def apportion(rows: DataFrame, seats: Column, value: Column, group: list[str], key: list[str], most: int = SORTED) -> DataFrame:
    """rows plus quota: `seats` of each group by Sainte-Lague on `value`, ties by key.

    A party's quota differs from its exact share x by at most x * parties / (2 * seats) + 1, so only the seats in that
    range are ranked; those below are sure. Ranked rows are about three for a party. Groups without value get none.
    """
    g = Window.partitionBy(*group)
    rows = rows.withColumns({"v": value.cast("double"), "n": seats.cast("double")})
    rows = rows.withColumns({"vs": F.sum("v").over(g), "parties": F.count(F.lit(1)).over(g)})
    exact = F.when(F.col("vs") > 0, F.col("v") / F.col("vs") * F.col("n")).otherwise(0.0)
    rows = rows.withColumn("x", exact)
    spread = F.when(F.col("n") > 0, F.col("x") * F.col("parties") / (F.col("n") * 2)).otherwise(0.0) + 1
    rows = rows.withColumn("sure", F.greatest(F.floor(F.col("x") - spread), F.lit(0)).cast("long"))
    rows = rows.withColumn("could", F.when(F.col("v") > 0, F.ceil(F.col("x") + spread)).otherwise(F.lit(0)).cast("long"))
    open_seats = F.col("n") - F.sum("sure").over(g)
    ranked = rows.withColumn("open", open_seats).select(
        *dict.fromkeys([*group, *key]), "open", "v", F.explode(F.sequence(F.col("sure"), F.col("could"))).alias("s")
    )
    ranked = ranked.where((F.col("v") > 0)).withColumn("q", F.col("v") / (F.col("s") * 2 + 1))
    won = _winners(save(ranked.where("open > 0"), "seats"), group, key, most).groupBy(*key).agg(F.count(F.lit(1)).alias("won"))
    won = won.select(*[F.col(k).alias(f"w_{k}") for k in key], "won")
    out = rows.join(won, _null_safe(key, [f"w_{k}" for k in key]), "left")
    return out.withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0))).drop(
        "v", "n", "vs", "parties", "x", "sure", "could", "won", *[f"w_{k}" for k in key]
    )


def _cover(at: Column, start: Column, length: Column, line: Column) -> Column:
    """Words of [0, at) in the cyclic run of `length` from `start` on a line of `line` words."""
    stop = start + length
    first = F.greatest(F.least(at, stop) - start, F.lit(0))
    wrapped = F.least(at, F.greatest(stop - line, F.lit(0)))
    return first + wrapped


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = 64, shard_words: int = 500_000) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row.

    Size counts the words of the whole text; sources in order of code point, null last, take `weights` in turn.
    `taken` counts words that the mix takes, repeats included, never over `most` (2) times the size. Empty and null
    texts have size and taken 0. Repeated rows are rows of their own. Ties in the seeded order go by doc_id and size.
    Blocks have `block` words, fewer where the smallest target asks for it. A source has a shard for each
    `shard_words` words, so no window holds more than a shard.
    """
    rows = save(sized(docs, seed), "sized")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    every = Window.partitionBy()
    small = F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(small / 100))).cast("long"))
    seats = F.round(F.sum("target").over(every) / F.col("block"))
    sources = sources.withColumn("all", F.lit(1)).withColumn("seats", F.coalesce(seats, F.lit(0)))
    sources = save(apportion(sources, F.col("seats"), F.col("target"), ["all"], ["source"]).drop("all", "seats"), "sources")
    sources = sources.withColumns({"shards": F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")})

    named = sources.select(F.col("source").alias("s_source"), "source_size", "target", "block", F.col("quota").alias("source_quota"), "shards")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", F.col("h") % F.col("shards"))
    shards = rows.groupBy("source", "shard", "source_quota", "block").agg(F.sum("size").alias("line"))
    # Shards of a source share its blocks by their size.
    shards = apportion(shards, F.col("source_quota"), F.col("line"), ["source"], ["source", "shard"])
    shards = shards.select(F.col("source").alias("t_source"), F.col("shard").alias("t_shard"), "line", F.col("quota").alias("blocks"))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("shard") == F.col("t_shard")))
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")
    line = F.col("line")
    words = F.least(F.col("blocks") * F.col("block"), line * 2)
    times = F.when(line > 0, F.floor(words / line)).otherwise(F.lit(0)).cast("long")
    # The run starts at a block's edge, drawn from the seed, the source and the shard.
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"run{seed}"), F.coalesce("source", F.lit("")), F.col("shard"))), 1, 12), 16, 10).cast("long")
    rows = rows.withColumns({"words": words, "times": times, "end": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.when(line > 0, (draw % F.greatest(F.ceil(line / F.col("block")), F.lit(1))) * F.col("block")).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumns({"start": start, "run": F.col("words") - F.col("times") * line})
    taken = F.col("times") * F.col("size") + _cover(F.col("end"), F.col("start"), F.col("run"), line) - _cover(F.col("end") - F.col("size"), F.col("start"), F.col("run"), line)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))

