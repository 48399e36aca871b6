"""Normalisers and fingerprints over long statistics (state, source, feature, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.infotheory import histogram
from ..functions.vectors import rescaled

SIGNAL = ["source", "feature"]


def normaliser(stats: DataFrame) -> DataFrame:
    """Per signal: index in canonical order, min, max, mean, stdev and count of its values."""
    per = stats.groupBy(*SIGNAL).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.count("value").alias("seen"))
    # One row per signal: sources and features are a fixed, small catalogue.
    return per.withColumn("signal", F.row_number().over(Window.orderBy(*SIGNAL)) - 1)


def merge_normalisers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Widest ranges of two normalisers."""
    return a.select(*SIGNAL, "lo", "hi").unionByName(b.select(*SIGNAL, "lo", "hi")).groupBy(*SIGNAL).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def running_scaled(rows: DataFrame, x: str) -> DataFrame:
    """Each value scaled by the range of its stream so far."""
    so_far = Window.partitionBy("stream_id").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.min(x).over(so_far), F.max(x).over(so_far)
    return rows.select("stream_id", "example", lo.alias("lo"), hi.alias("hi"), rescaled(F.col(x), lo, hi).alias("scaled"))


def flat_vectors(stats: DataFrame, keys: list[str], normal: DataFrame | None = None) -> DataFrame:
    """keys, vector: values in canonical order (source, then feature), scaled by a normaliser if one is given."""
    v = F.col("value")
    if normal is not None:
        stats = stats.join(normal.select(*SIGNAL, "lo", "hi"), SIGNAL)
        v = rescaled(v, F.col("lo"), F.col("hi"))
    item = F.struct("source", "feature", v.alias("v"))
    return stats.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("vector"))


def fingerprints(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, feature, mean, stdev (sample, 0 for one), seen."""
    return stats.groupBy(*keys, *SIGNAL).agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev"), F.count("value").alias("seen"))


def evolved_fingerprints(stats: DataFrame, keys: list[str], performance: list[str]) -> DataFrame:
    """Fingerprints where signals of `performance` sources or features count only the newest epoch.

    stats has a column epoch that rises when a state's model evolves; other signals use all epochs.
    """
    newest = F.max("epoch").over(Window.partitionBy(*keys))
    bound = F.col("source").isin(performance) | F.col("feature").isin(performance)
    return fingerprints(stats.withColumn("newest", newest).where(~bound | (F.col("epoch") == F.col("newest"))), keys)


def plastic_fingerprints(stats: DataFrame, keys: list[str], weight: float = 0.1) -> DataFrame:
    """Weighted means where values of epochs before the newest have `weight`."""
    newest = F.max("epoch").over(Window.partitionBy(*keys))
    w = F.when(F.col("epoch") == F.col("newest"), 1.0).otherwise(weight)
    rows = stats.withColumn("newest", newest).withColumn("w", w)
    return rows.groupBy(*keys, *SIGNAL).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"), F.sum("w").alias("seen"))


def histogram_fingerprints(stats: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """keys, source, feature, bin, n: equal bins over the range that all states share for a signal."""
    return histogram(stats, [*keys, *SIGNAL], "value", bins, SIGNAL).select(*keys, *SIGNAL, "bin", "n")


def valid(prints: DataFrame, least: int = 5) -> DataFrame:
    return prints.where(F.col("seen") > least)
