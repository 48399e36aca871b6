"""Sliding statistics of streams in native window expressions.

A frame holds the newest `w` rows of a stream, the current one included. Degenerate frames follow the incremental
rules: standard deviation 0 under two rows, skewness 0 and kurtosis -3 for constant frames, correlations 0.

A long stream is cut into blocks of rows; each takes the rows that its first frames reach back to from the block before.
So the frames of one stream, even of one that holds most rows, are computed by as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a block; frames must be shorter.
BLOCK = 1 << 18


def spread(rows: DataFrame, reach: int, block: int | None = None) -> DataFrame:
    """rows plus block and own; the last `reach` rows of a block occur again in the next one, there not its own."""
    size = block or BLOCK
    if reach >= size:
        raise ValueError("frames must be shorter than a block")
    at = F.floor(F.col("example") / size)
    again = F.when(F.col("example") % size >= size - reach, at + 1)
    copies = rows.withColumn("block", F.explode(F.array_compact(F.array(at, again))))
    return copies.withColumn("own", F.col("block") == at)


def order() -> Window:
    return Window.partitionBy("stream_id", "block").orderBy("example")


def _kept(rows: DataFrame, *columns) -> DataFrame:
    """The columns of each block's own rows, after the frames have been computed."""
    return rows.select("stream_id", "example", "own", *columns).where("own").drop("own")


def frame(w: int, start: int = 0, stop: int = 0) -> Window:
    """The frame without its first `start` and last `stop` rows."""
    return order().rowsBetween(-(w - 1) + start, -stop)


def mean(x: str, w: int) -> Column:
    return F.coalesce(F.avg(x).over(frame(w)), F.lit(0.0))


def stdev(x: str, w: int) -> Column:
    return F.coalesce(F.stddev_samp(x).over(frame(w)), F.lit(0.0))


def skew(x: str, w: int) -> Column:
    return F.coalesce(F.skewness(x).over(frame(w)), F.lit(0.0))


def kurtosis(x: str, w: int) -> Column:
    return F.coalesce(F.kurtosis(x).over(frame(w)), F.lit(-3.0))


def moments(rows: DataFrame, x: str, w: int) -> DataFrame:
    """mean, stdev, skew (biased) and kurtosis (excess) of the frame; all share one window."""
    return _kept(spread(rows, w), mean(x, w).alias("mean"), stdev(x, w).alias("stdev"), skew(x, w).alias("skew"), kurtosis(x, w).alias("kurtosis"))


def turning_point_rate(rows: DataFrame, x: str, w: int) -> DataFrame:
    """Strict sign changes of consecutive differences inside the frame, over its rows; 0 under three rows."""
    rows = spread(rows, w + 2)
    d = F.col(x) - F.lag(x).over(order())
    turn = rows.withColumn("d", d).withColumn("turn", (F.col("d") * F.lag("d").over(order()) < 0).cast("int"))
    n = F.count(F.lit(1)).over(frame(w))
    rate = F.when(n < 3, 0.0).otherwise(F.coalesce(F.sum("turn").over(frame(w, 2)), F.lit(0)) / n)
    return _kept(turn, rate.alias("turning_point_rate"))


def autocorrelations(rows: DataFrame, x: str, w: int) -> DataFrame:
    """acf and pacf of lags 1 and 2 of the frame.

    acf has biased autocovariances about the frame's mean; pacf solves Yule-Walker for denominators n - lag. Built from
    sums of lagged products, so no frame is collected. 0 for constant or short frames.
    """
    lagged = spread(rows, w + 2).withColumns({"x1": F.lag(x, 1).over(order()), "x2": F.lag(x, 2).over(order())})
    n = F.count(F.lit(1)).over(frame(w))
    out = _kept(
        lagged, n.cast("double").alias("n"), F.avg(x).over(frame(w)).alias("m"), F.var_pop(x).over(frame(w)).alias("c0"),
        *[
            c
            for k in (1, 2)
            for c in (
                F.sum(F.col(x) * F.col(f"x{k}")).over(frame(w, k)).alias(f"xy{k}"),
                F.sum(x).over(frame(w, k)).alias(f"late{k}"),
                F.sum(f"x{k}").over(frame(w, k)).alias(f"early{k}"),
                F.count(f"x{k}").over(frame(w, k)).alias(f"pairs{k}"),
                F.sum(F.when(F.col(f"x{k}").isNotNull(), F.col(x))).over(frame(w, k)).alias(f"paired{k}"),
            )
        ],
    )
    m, c0 = F.col("m"), F.col("c0")

    def cov(k: int) -> Column:
        s = F.col(f"xy{k}") - m * (F.col(f"paired{k}") + F.col(f"early{k}")) + F.col(f"pairs{k}") * m * m
        return F.when((F.col("n") > k) & (c0 > 1e-14), s / F.col("n") / c0).otherwise(0.0)

    out = out.withColumns({"acf_1": cov(1), "acf_2": cov(2)})
    u1 = F.when(F.col("n") > 1, F.col("acf_1") * F.col("n") / (F.col("n") - 1)).otherwise(0.0)
    u2 = F.when(F.col("n") > 2, F.col("acf_2") * F.col("n") / (F.col("n") - 2)).otherwise(0.0)
    out = out.withColumns({"u1": u1, "u2": u2})
    left = 1 - F.col("u1") * F.col("u1")
    p2 = F.when((F.col("n") > 2) & (F.abs(left) > 1e-12), (F.col("u2") - F.col("u1") * F.col("u1")) / left).otherwise(0.0)
    return out.select("stream_id", "example", "acf_1", "acf_2", F.col("u1").alias("pacf_1"), p2.alias("pacf_2"))


def error_distances(log: DataFrame) -> DataFrame:
    """Rows between an error and the one before, on error rows; a stream's first error has none."""
    errors = log.where("is_correct = 0")
    gap = F.col("example") - F.lag("example").over(Window.partitionBy("stream_id").orderBy("example"))
    return errors.select("stream_id", "example", gap.alias("error_distance")).where("error_distance is not null")


def rolling_mean(rows: DataFrame, x: str, w: int) -> DataFrame:
    """Mean of the newest w rows, null until there are that many."""
    full = F.count(F.lit(1)).over(frame(w)) == w
    return _kept(spread(rows, w), F.when(full, F.avg(x).over(frame(w))).alias("rolling_mean"))


def stable_mean(rows: DataFrame, x: str, w: int, buffer: int) -> DataFrame:
    """Mean of the w rows that are older than the newest `buffer` rows."""
    old = order().rowsBetween(-(buffer + w - 1), -buffer)
    return _kept(spread(rows, buffer + w), F.avg(x).over(old).alias("stable_mean"))


def correlation(x: str, y: str, over: Window | None = None) -> Column:
    """Pearson correlation of the rows with both values; null where one of them is constant, also in ANSI mode."""

    def of(c: Column) -> Column:
        return c if over is None else c.over(over)

    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    width = of(F.stddev_pop(a)) * of(F.stddev_pop(b))
    return of(F.covar_pop(x, y)) / F.nullif(width, F.lit(0.0))


def lag_correlation(rows: DataFrame, x: str, lag: int, w: int) -> DataFrame:
    """Pearson correlation of a frame with itself `lag` rows before; null for constant frames."""
    r = spread(rows, w + lag).withColumn("before", F.lag(x, lag).over(order()))
    return _kept(r, correlation(x, "before", frame(w)).alias("lag_correlation"))


def running_regression(rows: DataFrame, x: str, y: str, w: int) -> DataFrame:
    """Slope, intercept and correlation of y on x over the frame; null for constant x, the correlation for constant y too."""
    f = frame(w)
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    slope = F.covar_pop(x, y).over(f) / F.nullif(F.var_pop(a).over(f), F.lit(0.0))
    return _kept(spread(rows, w), slope.alias("slope"), (F.avg(b).over(f) - slope * F.avg(a).over(f)).alias("intercept"), correlation(y, x, f).alias("correlation"))


def window_sources(rows: DataFrame, features: list[str]) -> DataFrame:
    """Long form (stream_id, example, source, value) of features, labels, predictions and errors (1 = correct)."""
    names = {**{f: F.col(f).cast("double") for f in features}, "labels": F.col("y").cast("double"), "predictions": F.col("p").cast("double"), "errors": F.col("is_correct").cast("double")}
    wide = rows.select("stream_id", "example", *[c.alias(n) for n, c in names.items()])
    return wide.unpivot(["stream_id", "example"], list(names), "source", "value")


def window_stats(rows: DataFrame, features: list[str], w: int, every: int = 1, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Long form (stream_id, example, source, feature, value) of mean, stdev, skew and kurtosis at every n-th row.

    ignore: features to leave out. Frames are computed before rows are left out. Each source has its own window partition.
    """
    by = Window.partitionBy("stream_id", "block", "source").orderBy("example").rowsBetween(-(w - 1), 0)
    long = spread(window_sources(rows, features), w)
    stats = _kept(
        long, "source",
        F.avg("value").over(by).alias("mean"), F.coalesce(F.stddev_samp("value").over(by), F.lit(0.0)).alias("stdev"),
        F.coalesce(F.skewness("value").over(by), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis("value").over(by), F.lit(-3.0)).alias("kurtosis"),
    )
    return stats.where(F.col("example") % every == every - 1).unpivot(["stream_id", "example", "source"], [f for f in ("mean", "stdev", "skew", "kurtosis") if f not in ignore], "feature", "value")
