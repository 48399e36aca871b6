"""Transition counts, priors, posteriors and the swap test as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import running
from .windows import correlation

EDGE = ["stream_id", "src", "dst"]


def counts(log: DataFrame, model: str = "active_model", changes_only: bool = False) -> DataFrame:
    """(stream_id, src, dst, n): how often one row's model follows another's; only unlike ones for the change matrix."""
    rows = log.select("stream_id", "example", F.col(model).alias("dst"))
    steps = running(rows, src=("before", F.col("dst"))).where("src is not null")
    if changes_only:
        steps = steps.where("src <> dst")
    return steps.groupBy(*EDGE).agg(F.count(F.lit(1)).cast("double").alias("n"))


def with_back_edges(change: DataFrame, prior: float) -> DataFrame:
    """Adds a pseudo-count from every state back to the ones it was first reached from."""
    back = change.select("stream_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(float(prior)).alias("n"))
    return change.unionByName(back).groupBy(*EDGE).agg(F.sum("n").alias("n"))


def probabilities(edges: DataFrame) -> DataFrame:
    return edges.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("stream_id", "src"))).select(*EDGE, "p")


def smoothed(probs: DataFrame, states: DataFrame, least: float = 0.7, penalty: float = 1.0) -> DataFrame:
    """Every pair of a stream's states (stream_id, state): penalty * p * (1 - least) + least, normalised per source.

    A stream has few states, so pairs of states inside a stream are a small table.
    """
    a, b = states.select("stream_id", F.col("state").alias("src")), states.select("stream_id", F.col("state").alias("dst"))
    full = a.join(b, "stream_id").join(probs, EDGE, "left")
    w = F.coalesce("p", F.lit(0.0)) * penalty * (1 - least) + least
    full = full.withColumn("w", w)
    return full.withColumn("prior", F.col("w") / F.sum("w").over(Window.partitionBy("stream_id", "src"))).select(*EDGE, F.col("w").alias("weight"), "prior")


def hop(probs: DataFrame, further: DataFrame) -> DataFrame:
    """Probabilities of reaching dst in one step of `probs` and then one of `further`."""
    nxt = further.select("stream_id", F.col("src").alias("mid"), F.col("dst"), F.col("p").alias("q"))
    return probs.select("stream_id", "src", F.col("dst").alias("mid"), "p").join(nxt, ["stream_id", "mid"]).groupBy(*EDGE).agg(F.sum(F.col("p") * F.col("q")).alias("p"))


def posteriors(likelihood: DataFrame, priors: list[tuple[DataFrame, float]], least: float = 0.005, zero: float = 0.7) -> DataFrame:
    """(stream_id, src, dst, weight, posterior, rank): max(L, least) times the largest smoothed prior.

    likelihood: (stream_id, state, likelihood). priors: (edges with p, penalty) for each number of hops. Rank 1 is the
    winner; of equal posteriors the later state wins.
    """
    joined = likelihood.select("stream_id", F.col("state").alias("dst"), "likelihood").join(likelihood.select("stream_id", F.col("state").alias("src")), "stream_id")
    names = []
    for i, (p, penalty) in enumerate(priors):
        joined = joined.join(p.select(*EDGE, F.col("p").alias(f"p{i}")), EDGE, "left")
        joined = joined.withColumn(f"p{i}", F.coalesce(f"p{i}", F.lit(0.0)) * penalty * (1 - zero) + zero)
        names.append(f"p{i}")
    top = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    w = joined.withColumn("weight", F.greatest("likelihood", F.lit(least)) * top)
    g = Window.partitionBy("stream_id", "src")
    w = w.withColumn("posterior", F.col("weight") / F.sum("weight").over(g))
    return w.withColumn("rank", F.row_number().over(g.orderBy(F.desc("posterior"), F.desc("dst")))).select(*EDGE, "weight", "posterior", "rank")


def swap_bound(n0: Column, n1: Column, v0: Column, risk: float = 0.75) -> Column:
    """Variance-sensitive bound on the difference of two means with widths n0 and n1."""
    m = 1 / (1 / n0 + 1 / n1)
    d = F.log(2 * F.log(n0 + n1) / risk)
    return F.sqrt(2 / m * v0 * d) + 2 / (3 * m) * d


def swaps(pairs: DataFrame, risk: float = 0.75) -> DataFrame:
    """pairs (n0, u0, v0, n1, u1) plus bound and swap: whether state 1 is better by more than the bound."""
    b = swap_bound(F.col("n0"), F.col("n1"), F.col("v0"), risk)
    return pairs.withColumn("bound", b).withColumn("swap", (F.col("u1") > F.col("u0")) & (F.col("u1") - F.col("u0") >= F.col("bound")))


def hoeffding_bound(r: float, delta: float, n: Column) -> Column:
    return F.sqrt(F.lit(r * r) * F.log(F.lit(1 / delta)) / (2 * n))


def remapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges after merging states: mapping (stream_id, old, model); counts of merged rows and columns add up."""
    m = mapping.select("stream_id", F.col("old").alias("src"), F.col("model").alias("new_src"))
    k = mapping.select("stream_id", F.col("old").alias("dst"), F.col("model").alias("new_dst"))
    out = edges.join(m, ["stream_id", "src"], "left").join(k, ["stream_id", "dst"], "left")
    return out.groupBy("stream_id", F.coalesce("new_src", "src").alias("src"), F.coalesce("new_dst", "dst").alias("dst")).agg(F.sum("n").alias("n"))


def correlations(series: DataFrame, above: float | None = None) -> DataFrame:
    """(stream_id, a, b, n, correlation) of likelihood series (stream_id, example, state, value) of pairs a < b.

    Joined on the row, so work grows with rows times the few states alive. Under two rows or constant: 0.
    """
    x = series.select("stream_id", "example", F.col("state").alias("a"), F.col("value").alias("va"))
    y = series.select("stream_id", "example", F.col("state").alias("b"), F.col("value").alias("vb"))
    c = x.join(y, ["stream_id", "example"]).where("a < b").groupBy("stream_id", "a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("va", "vb").alias("correlation"))
    c = c.withColumn("correlation", F.coalesce(F.nanvl("correlation", F.lit(0.0)), F.lit(0.0)))
    return c if above is None else c.where(F.col("correlation") > above)
