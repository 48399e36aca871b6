"""Streams from concepts: recurrence patterns, segments, ground truth, gradual drift, label noise."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def recurrence_pattern(concepts: int, repeats: int, seed: int, dropoff: float = 1.0, forward: int = 1, noise: float = 0.0) -> list[int]:
    """A walk of concepts * repeats places over a circular Markov chain.

    From concept c the k-th neighbour ahead (k up to `forward`) has weight dropoff ** k, to which every concept adds
    uniform noise of up to `noise`; weights are normalised. With one neighbour and no noise the order is the circle.
    """
    rng = random.Random(seed)
    rows = []
    for c in range(concepts):
        w = [noise * rng.random() for _ in range(concepts)]
        for k in range(1, forward + 1):
            w[(c + k) % concepts] += dropoff**k
        total = sum(w)
        rows.append([x / total for x in w] if total else [1 / concepts] * concepts)
    out, at = [], 0
    for _ in range(concepts * repeats):
        out.append(at)
        at = rng.choices(range(concepts), rows[at])[0]
    return out


def segments(spark: SparkSession, lengths: dict[str, int], order: list[str], proportion: float = 1.0, concept_max: int = 0) -> DataFrame:
    """(segment, start, end inclusive, concept) laid out one after the other.

    lengths: rows of each concept; each visit takes `proportion` of them (-1: an equal share for each visit).
    concept_max > 0 keeps only the first so many concepts by name.
    """
    kept = sorted(lengths)[:concept_max] if concept_max > 0 else sorted(lengths)
    order = [c for c in order if c in kept]
    rows, at = [], 0
    for i, c in enumerate(order):
        n = int(lengths[c] / order.count(c)) if proportion == -1 else int(lengths[c] * proportion)
        rows.append((i, at, at + n - 1, c))
        at += n
    return spark.createDataFrame(rows, "segment long, start long, end long, concept string")


def laid_out(lengths: DataFrame) -> DataFrame:
    """The same from a table (stream_id, segment, concept, length) of any size: prefix sums inside each stream."""
    upto = F.sum("length").over(Window.partitionBy("stream_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0))
    return lengths.select("stream_id", "segment", "concept", (upto - F.col("length")).alias("start"), (upto - 1).alias("end"))


def locate(rows: DataFrame, pieces: DataFrame, exclusive: bool = False) -> DataFrame:
    """rows plus segment, concept and start of the piece with start <= example <= end (< with `exclusive`), else null.

    pieces: (stream_id, segment, start, end, concept), disjoint. An as-of join by one window per stream: both sides meet
    sorted by place, so there is neither a nested loop nor a broadcast of the pieces.
    """
    names = rows.columns
    left = rows.select("stream_id", "example", F.struct(*names).alias("row"), F.lit(None).cast(pieces.select(F.struct("segment", "start", "end", "concept").alias("s")).schema["s"].dataType).alias("piece"))
    right = pieces.select("stream_id", F.col("start").alias("example"), F.lit(None).cast(left.schema["row"].dataType).alias("row"), F.struct("segment", "start", "end", "concept").alias("piece"))
    order = Window.partitionBy("stream_id").orderBy("example", F.col("piece").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = right.unionByName(left).withColumn("found", F.last("piece", ignorenulls=True).over(order)).where("row is not null")
    end = F.col("found.end") - (1 if exclusive else 0)
    ok = F.col("example") <= end
    return met.select("row.*", F.when(ok, F.col("found.segment")).alias("segment"), F.when(ok, F.col("found.concept")).alias("concept"), F.when(ok, F.col("found.start")).alias("start"))


def drawn(seed: int, *keys: str) -> Column:
    """A uniform draw in [0, 1) by hash of the seed and the keys: the same on every engine run and partitioning."""
    h = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), 1, 12)
    return F.conv(h, 16, 10).cast("double") / float(1 << 48)


def gradual(rows: DataFrame, pieces: DataFrame, width: int, seed: int) -> DataFrame:
    """rows of `locate` plus source_concept: near a boundary the neighbouring concept by chance.

    Within width / 2 rows of a boundary the chance of the neighbour falls from one half at the boundary to none.
    """
    o = Window.partitionBy("stream_id").orderBy("segment")
    around = pieces.select("stream_id", "segment", F.col("end").alias("stop"), F.lag("concept").over(o).alias("before"), F.lead("concept").over(o).alias("after"))
    near = rows.join(around, ["stream_id", "segment"], "left")
    half = width / 2
    since, left = F.col("example") - F.col("start"), F.col("stop") - F.col("example") + 1
    chance = lambda d: F.when(d < half, 0.5 - d / width).otherwise(0.0) if width else F.lit(0.0)
    u = drawn(seed, "stream_id", "example")
    pick = (
        F.when(F.col("before").isNotNull() & (u < chance(since)), F.col("before"))
        .when(F.col("after").isNotNull() & (u < chance(left)), F.col("after"))
        .otherwise(F.col("concept"))
    )
    return near.withColumn("source_concept", pick).drop("stop", "before", "after")


def compose(concepts: DataFrame, located: DataFrame) -> DataFrame:
    """Rows of each place's concept: a concept that is shorter than its segment starts over.

    concepts: (concept, position from 0, x, y). located: (stream_id, example, segment, start, concept).
    """
    n = concepts.groupBy("concept").agg(F.count(F.lit(1)).alias("rows"))
    at = located.where("concept is not null").join(n, "concept").withColumn("position", F.pmod(F.col("example") - F.col("start"), F.col("rows")))
    return at.join(concepts, ["concept", "position"]).select("stream_id", "example", "segment", "concept", "x", "y")


def label_noise(rows: DataFrame, classes: list[int], noise: float, seed: int) -> DataFrame:
    """y replaced by a uniform class with probability `noise`."""
    u, v = drawn(seed, "stream_id", "example"), drawn(seed + 1, "stream_id", "example")
    pick = F.element_at(F.array(*[F.lit(c) for c in classes]), (F.floor(v * len(classes)) + 1).cast("int"))
    return rows.withColumn("y", F.when(u < noise, pick).otherwise(F.col("y")))


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """position by seeded hash inside each concept; ties by key."""
    place = Window.partitionBy("concept").orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return rows.withColumn("position", F.row_number().over(place).cast("long") - 1)


def classes(rows: DataFrame) -> DataFrame:
    return rows.select("y").distinct().orderBy("y")
