"""Entropies, divergences and histogram bins as native expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAUSS = math.log2(2 * math.pi * math.e) / 2


def gaussian_entropy(sigma: Column) -> Column:
    """Bits of a normal distribution."""
    return F.lit(GAUSS) + F.log2(sigma)


def uniform_entropy(sigma: Column) -> Column:
    """Bits of a uniform distribution of width 4 sigma."""
    return F.log2(4 * sigma)


def gaussian_kl(m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    """KL divergence of two normals in nats."""
    return F.log(s2 / s1) + (s1 * s1 + (m1 - m2) * (m1 - m2)) / (2 * s2 * s2) - 0.5


def bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin from 0; the upper edge and a zero range fall into the last one."""
    return F.when(hi > lo, F.least(F.floor((v - lo) / ((hi - lo) / bins)), F.lit(bins - 1))).otherwise(F.lit(bins - 1)).cast("int")


def histogram(rows: DataFrame, keys: list[str], value: str, bins: int, range_keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n: counts of `value` in equal bins over its range per `range_keys` (keys by default)."""
    ends = rows.groupBy(*(range_keys or keys)).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = rows.join(ends, range_keys or keys).withColumn("bin", bin_of(F.col(value), F.col("lo"), F.col("hi"), bins))
    return placed.groupBy(*keys, "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """keys, total, entropy in bits of each group of counts; zero counts add nothing."""
    share = F.col(n) / F.sum(n).over(Window.partitionBy(*keys))
    own = counts.withColumn("p", share)
    return own.groupBy(*keys).agg(F.sum(n).alias("total"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log2("p")).otherwise(0.0)).alias("entropy"))


def rebin(counts: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Histograms (keys, bin, lo, hi, n with `old` bins) moved to `bins` bins over the range of all of them.

    Each old count goes to the new bin that holds the old bin's midpoint. counts has a column old with its bin number.
    """
    ends = counts.agg(F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"))
    # One row, so its broadcast is bounded.
    both = counts.crossJoin(F.broadcast(ends))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / F.col("old")
    placed = both.withColumn("new_bin", bin_of(mid, F.col("all_lo"), F.col("all_hi"), bins))
    return placed.groupBy(*keys, F.col("new_bin").alias("bin")).agg(F.sum("n").alias("n"))


def mutual_information(counts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, mi: entropy of the merged histogram minus the count-weighted entropies of the groups, at least 0.

    counts: keys, group, bin, n on common bins.
    """
    merged = entropy(counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n")), keys).select(*keys, F.col("entropy").alias("h"), F.col("total").alias("all"))
    each = entropy(counts, [*keys, group]).join(merged, keys)
    given = F.sum(F.col("entropy") * F.col("total") / F.col("all"))
    return each.groupBy(*keys, "h").agg(given.alias("given")).select(*keys, F.greatest(F.col("h") - F.col("given"), F.lit(0.0)).alias("mi"))


def gaussian_bins(concepts: DataFrame, lo: float, hi: float, bins: int) -> DataFrame:
    """(concept, bin, n): a concept's normal (mu, sigma, seen) spread over bins; the first takes the lower tail."""
    from .vectors import normal_cdf

    width = (hi - lo) / bins
    rows = concepts.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    at = lambda edge: normal_cdf((edge - F.col("mu")) / F.greatest(F.col("sigma"), F.lit(0.01)))
    right = at(F.lit(lo) + (F.col("bin") + 1) * width)
    left = F.when(F.col("bin") == 0, 0.0).otherwise(at(F.lit(lo) + F.col("bin") * width))
    return rows.select("concept", "bin", (F.col("seen") * (right - left)).alias("n"))


def gaussian_information_gain(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gain: entropy of the pooled normal minus the weighted entropies of the groups (mu, sigma, seen), in bits."""
    total = F.sum("seen").over(Window.partitionBy(*keys))
    w = groups.withColumn("w", F.col("seen") / total)
    pooled = w.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("mu")).alias("m"),
        F.sum(F.col("w") * (F.col("sigma") ** 2 + F.col("mu") ** 2)).alias("m2"),
        F.sum(F.col("w") * gaussian_entropy(F.col("sigma"))).alias("given"),
    )
    return pooled.select(*keys, (gaussian_entropy(F.sqrt(F.col("m2") - F.col("m") ** 2)) - F.col("given")).alias("gain"))


def divergences(pairs: DataFrame) -> DataFrame:
    """pairs (m1, s1, m2, s2) plus KL, its swapped and its symmetric form, and the summed-variance difference, in nats."""
    a = gaussian_kl(F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2"))
    b = gaussian_kl(F.col("m2"), F.col("s2"), F.col("m1"), F.col("s1"))
    both = F.log(F.sqrt(F.col("s1") ** 2 + F.col("s2") ** 2)) - (F.log("s1") + F.log("s2")) / 2
    return pairs.withColumns({"kl": a, "kl_swap": b, "kl_sym": a + b, "js": both})


def uniform_information_gain(groups: DataFrame, keys: list[str]) -> DataFrame:
    """As `gaussian_information_gain` with uniform distributions of width 4 sigma."""
    total = F.sum("seen").over(Window.partitionBy(*keys))
    w = groups.withColumn("w", F.col("seen") / total)
    pooled = w.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("mu")).alias("m"),
        F.sum(F.col("w") * (F.col("sigma") ** 2 + F.col("mu") ** 2)).alias("m2"),
        F.sum(F.col("w") * uniform_entropy(F.col("sigma"))).alias("given"),
    )
    return pooled.select(*keys, (uniform_entropy(F.sqrt(F.col("m2") - F.col("m") ** 2)) - F.col("given")).alias("gain"))


def conditional_entropy(counts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """keys, h, given, gain, share: entropy of the bins, its mean inside the groups, the difference and that over h (0 for h = 0)."""
    merged = entropy(counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n")), keys).select(*keys, F.col("entropy").alias("h"), F.col("total").alias("all"))
    each = entropy(counts, [*keys, group]).join(merged, keys)
    g = each.groupBy(*keys, "h").agg(F.sum(F.col("entropy") * F.col("total") / F.col("all")).alias("given"))
    gain = F.col("h") - F.col("given")
    return g.select(*keys, "h", "given", gain.alias("gain"), F.when(F.col("h") > 0, gain / F.col("h")).otherwise(0.0).alias("share"))
