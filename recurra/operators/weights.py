"""Feature weights from fingerprints: how well a signal tells concepts apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infotheory import bin_of, mutual_information
from ..functions.vectors import normal_cdf
from .fingerprints import SIGNAL, histogram_fingerprints


def fisher(groups: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """keys, fisher: between-group variance of means (mean, seen) over the overall variance (column overall, a stdev).

    With `within`, a stdev per group, the weighted within-group variance is the divisor where it is positive.
    A zero divisor gives 0.
    """
    g = Window.partitionBy(*keys)
    rows = groups.withColumn("w", F.col("seen") / F.sum("seen").over(g))
    rows = rows.withColumn("mu", F.sum(F.col("w") * F.col("mean")).over(g))
    inner = F.sum(F.col("w") * F.col(within) ** 2) if within else F.lit(0.0)
    per = rows.groupBy(*keys).agg(F.sum(F.col("w") * (F.col("mean") - F.col("mu")) ** 2).alias("between"), inner.alias("inner"), F.max("overall").alias("overall"))
    divisor = F.when(F.col("inner") > 0, F.col("inner")).otherwise(F.col("overall") ** 2)
    return per.select(*keys, F.when(divisor > 0, F.col("between") / divisor).otherwise(0.0).alias("fisher"))


def scale(prints: DataFrame, normal: DataFrame) -> DataFrame:
    """Per signal: 0.01 over the mean scaled stdev (count weighted, at least 0.01), and the number of states.

    Signals with a zero range have none.
    """
    n = normal.where("hi > lo").select(*SIGNAL, (F.col("hi") - F.col("lo")).alias("width"), F.col("lo").alias("low"), F.col("stdev").alias("all_stdev"))
    rows = prints.join(n, SIGNAL)
    spread = F.sum(F.col("seen") * F.col("stdev") / F.col("width")) / F.sum("seen")
    return rows.groupBy(*SIGNAL, "width", "low", "all_stdev").agg((0.01 / F.greatest(spread, F.lit(0.01))).alias("scale"), F.count(F.lit(1)).alias("states"))


def fisher_overall(active: DataFrame, other: DataFrame, normal: DataFrame, within: bool = False) -> DataFrame:
    """Per signal the weight max(Fisher between states, mean Fisher of a state against itself under others) * scale.

    active: state, source, feature, mean, stdev, seen. other: the same plus observed_under, fingerprints of a state
    taken while another one was active. One state: the scale alone. A zero range: null (see `completed`).
    """
    s = scale(active, normal)
    scaled = lambda df: df.join(s, SIGNAL).withColumns(
        {"mean": (F.col("mean") - F.col("low")) / F.col("width"), "stdev": F.col("stdev") / F.col("width"), "overall": F.col("all_stdev") / F.col("width")}
    )
    sd = "stdev" if within else None
    between = fisher(scaled(active), SIGNAL, sd).withColumnRenamed("fisher", "between")
    both = active.select("state", *SIGNAL, "mean", "stdev", "seen").unionByName(other.select("state", *SIGNAL, "mean", "stdev", "seen"))
    own = fisher(scaled(both), ["state", *SIGNAL], sd).groupBy(*SIGNAL).agg(F.avg("fisher").alias("own"))
    joined = normal.select(*SIGNAL).join(s, SIGNAL, "left").join(between, SIGNAL, "left").join(own, SIGNAL, "left")
    w = F.when(F.col("states") < 2, F.col("scale")).otherwise(F.greatest("between", "own") * F.col("scale"))
    return joined.select(*SIGNAL, w.alias("weight"))


def original(active: DataFrame, other: DataFrame, normal: DataFrame) -> DataFrame:
    """Per signal the larger of the stdev of scaled state means and the mean stdev of states under others, times scale."""
    n = normal.where("hi > lo").select(*SIGNAL, (F.col("hi") - F.col("lo")).alias("width"), F.col("lo").alias("low"))
    s = active.join(n, SIGNAL).groupBy(*SIGNAL, "width", "low").agg(F.avg(F.col("stdev") / F.col("width")).alias("spread"), F.count(F.lit(1)).alias("states"))
    s = s.withColumn("scale", F.when(F.col("spread") > 0, 0.01 / F.greatest("spread", F.lit(0.01))))
    z = (F.col("mean") - F.col("low")) / F.col("width") * F.col("scale")
    between = active.join(s, SIGNAL).groupBy(*SIGNAL).agg(F.stddev_pop(z).alias("between"))
    both = active.select("state", *SIGNAL, "mean").unionByName(other.select("state", *SIGNAL, "mean"))
    own = both.join(s, SIGNAL).groupBy("state", *SIGNAL).agg(F.stddev_pop(z).alias("sd")).groupBy(*SIGNAL).agg(F.avg("sd").alias("own"))
    joined = normal.select(*SIGNAL).join(s, SIGNAL, "left").join(between, SIGNAL, "left").join(own, SIGNAL, "left")
    return joined.select(*SIGNAL, F.when(F.col("states") < 2, F.col("scale")).otherwise(F.greatest("between", "own")).alias("weight"))


def histogram_mi(stats: DataFrame, normal: DataFrame, prints: DataFrame, bins: int = 10) -> DataFrame:
    """Per signal the mutual information of its histogram and the state, times scale."""
    mi = mutual_information(histogram_fingerprints(stats, ["state"], bins), SIGNAL, "state")
    return normal.select(*SIGNAL).join(scale(prints, normal), SIGNAL, "left").join(mi, SIGNAL, "left").select(*SIGNAL, (F.col("mi") * F.col("scale")).alias("weight"))


def gaussian_mi(prints: DataFrame, normal: DataFrame, bins: int = 10) -> DataFrame:
    """Per signal the mutual information of bin and state from the states' normals over the unit range, times scale."""
    s = scale(prints, normal)
    scaled = prints.join(s, SIGNAL).select("state", *SIGNAL, ((F.col("mean") - F.col("low")) / F.col("width")).alias("mu"), F.greatest(F.col("stdev") / F.col("width"), F.lit(0.01)).alias("sigma"), F.col("seen").cast("double").alias("seen"))
    rows = scaled.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = lambda edge: normal_cdf((edge - F.col("mu")) / F.col("sigma"))
    left = F.when(F.col("bin") == 0, 0.0).otherwise(at(F.col("bin") / bins))
    right = F.when(F.col("bin") == bins - 1, 1.0).otherwise(at((F.col("bin") + 1) / bins))
    mass = rows.select("state", *SIGNAL, "bin", (F.col("seen") * (right - left)).alias("n"))
    mi = mutual_information(mass, SIGNAL, "state")
    return normal.select(*SIGNAL).join(s, SIGNAL, "left").join(mi, SIGNAL, "left").select(*SIGNAL, (F.col("mi") * F.col("scale")).alias("weight"))


def log_probability(stats: DataFrame, prints: DataFrame, normal: DataFrame, bins: int = 10) -> DataFrame:
    """keys of stats, state, log_probability: the sum of log shares of the bins that a description's values fall into.

    prints: histogram fingerprints (state, source, feature, bin, n) over the normaliser's ranges; an empty bin counts as
    half a value. Every stored state judges every description; states are few.
    """
    ends = normal.select(*SIGNAL, "lo", "hi")
    placed = stats.join(ends, SIGNAL).withColumn("bin", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins)).select("stream_id", "example", *SIGNAL, "bin")
    total = prints.groupBy("state", *SIGNAL).agg(F.sum("n").alias("total"))
    every = placed.join(total, SIGNAL).join(prints, ["state", *SIGNAL, "bin"], "left")
    share = F.coalesce(F.col("n").cast("double"), F.lit(0.5)) / F.col("total")
    return every.groupBy("stream_id", "example", "state").agg(F.sum(F.log(share)).alias("log_probability"))


def uniform(normal: DataFrame) -> DataFrame:
    return normal.select(*SIGNAL, F.lit(1.0).alias("weight"))


def completed(weights: DataFrame, none: float = 0.01) -> DataFrame:
    """Null weights take the least weight of all signals, `none` where all are null; with the rank from the largest."""
    every = Window.partitionBy()
    w = F.coalesce("weight", F.min("weight").over(every), F.lit(none))
    filled = weights.withColumn("weight", w)
    return filled.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), *SIGNAL)))


METHODS = {
    "uniform": uniform, "None": uniform, "fisher_overall": fisher_overall, "default": fisher_overall,
    "fisher": lambda a, o, n: fisher_overall(a, o, n, within=True), "original": original,
    "gaussian_approx": gaussian_mi, "CacheMIHy": gaussian_mi, "histogram": histogram_mi, "Cachehistogram_MI": histogram_mi,
}


def by_name(name: str) -> Column:
    if name not in METHODS:
        raise ValueError(f"unknown weighting {name!r}; one of {sorted(METHODS)}")
    return METHODS[name]
