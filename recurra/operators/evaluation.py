"""Scores of experience logs: accuracies, the kappa family, concept matching, horizons, runs, discrimination.

A log has stream_id, example and what each operator names; windows always stay inside a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S = ["stream_id"]


def _order() -> Window:
    return Window.partitionBy(*S).orderBy("example")


def _so_far() -> Window:
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


#: Rows of a block of a stream.
BLOCK = 1 << 18


def running(log: DataFrame, by: list[str] = S, **kinds: tuple[str, Column]) -> DataFrame:
    """log plus columns that depend on all rows of a stream so far, one for each name=(kind, value).

    sum, max and last (not null) include the row; before is the value of the row before, next the first value that is not
    null from the row on. They run inside blocks of rows and take what comes from other blocks out of one row per block, so
    no task holds a whole stream.
    """
    mine = {n: f"__{n}" for n in kinds}
    rows = log.withColumns({"__block": F.floor(F.col("example") / BLOCK), **{mine[n]: v for n, (_, v) in kinds.items()}})
    here = Window.partitionBy(*by, "__block").orderBy("example")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    # What follows is read backwards: a frame that ends at the last row is gone through anew for every row.
    ahead = Window.partitionBy(*by, "__block").orderBy(F.desc("example")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy(*by).orderBy("__block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    per, carried, out = [], {}, {}
    for n, (kind, _) in kinds.items():
        c, k = F.col(mine[n]), f"__from_{n}"
        known = F.when(c.isNotNull(), F.col("example"))
        if kind == "sum":
            per.append(F.sum(c).alias(k))
            carried[k] = F.sum(k).over(earlier)
            out[n] = F.coalesce(F.col(k), F.lit(0)) + F.sum(c).over(so_far)
        elif kind == "max":
            per.append(F.max(c).alias(k))
            carried[k] = F.max(k).over(earlier)
            out[n] = F.greatest(F.col(k), F.max(c).over(so_far))
        elif kind == "last":
            per.append(F.max_by(c, known).alias(k))
            carried[k] = F.last(k, ignorenulls=True).over(earlier)
            out[n] = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(k))
        elif kind == "next":
            per.append(F.min_by(c, known).alias(k))
            carried[k] = F.last(k, ignorenulls=True).over(later)
            out[n] = F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.col(k))
        elif kind == "before":
            per.append(F.max_by(F.struct(c.alias("v")), "example").alias(k))
            carried[k] = F.lag(k).over(blocks)
            out[n] = F.coalesce(F.lag(F.struct(c.alias("v"))).over(here), F.col(k))["v"]
        else:
            raise ValueError(f"unknown kind {kind!r}")
    table = rows.groupBy(*by, "__block").agg(*per).withColumns(carried)
    names = [f"__by_{c}" for c in [*by, "__block"]]
    table = table.withColumnsRenamed(dict(zip([*by, "__block"], names, strict=True)))
    on = F.lit(True)
    for a, b in zip([*by, "__block"], names, strict=True):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return rows.join(table, on).withColumns(out).drop(*mine.values(), *names, *carried, "__block")


def running_accuracy(log: DataFrame, block: int = 1 << 18) -> DataFrame:
    """right_sum, wrong_sum and overall_accuracy of every row over its stream so far.

    Sums run inside blocks of rows and start from the totals of the blocks before, so a long stream is spread over tasks.
    """
    rows = log.select("stream_id", "example", "is_correct", F.floor(F.col("example") / block).alias("block"))
    before = Window.partitionBy("stream_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("stream_id", "block").agg(F.sum("is_correct").alias("right"), F.count(F.lit(1)).alias("seen"))
    totals = totals.select("stream_id", "block", F.coalesce(F.sum("right").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("seen").over(before), F.lit(0)).alias("n0"))
    here = Window.partitionBy("stream_id", "block").orderBy("example").rowsBetween(Window.unboundedPreceding, 0)
    right, seen = F.col("r0") + F.sum("is_correct").over(here), F.col("n0") + F.count(F.lit(1)).over(here)
    sums = rows.join(totals, ["stream_id", "block"]).select("stream_id", "example", right.alias("right_sum"), seen.alias("seen"))
    return sums.select("stream_id", "example", "right_sum", (F.col("seen") - F.col("right_sum")).alias("wrong_sum"), (F.col("right_sum") / F.col("seen")).alias("overall_accuracy"))


def kappas(log: DataFrame, by: list[str] = S, label_only: bool = False) -> DataFrame:
    """rows, accuracy, kappa, kappa_m and kappa_t of each group.

    kappa and kappa_m are 0 where their reference accuracy is 1; kappa_t is null there (a stream that always repeats
    its label). The label before a stream's first is 0. label_only: the expected agreement of kappa uses the labels in
    place of the predictions, as some published tables do.
    """
    marked = running(log, prev=("before", F.col("y")))
    marked = marked.withColumn("same", (F.coalesce("prev", F.lit(0)) == F.col("y")).cast("int"))
    # One map-side combined count; all else works on a row per group, label and prediction.
    cells = marked.groupBy(*by, "y", "p").agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("right"), F.sum("same").alias("same"))
    labels = cells.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("gt"))
    guesses = cells.groupBy(*by, F.col("p").alias("c")).agg(F.sum("n").alias("pred"))
    if label_only:
        guesses = labels.withColumnRenamed("gt", "pred")
    both = labels.join(guesses, [*by, "c"], "left").groupBy(*by).agg(F.sum(F.col("gt") * F.coalesce("pred", F.lit(0))).alias("agree"), F.max("gt").alias("major"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("right").alias("right"), F.sum("same").alias("same"))
    n = F.col("rows").cast("double")
    acc, e, m, t = F.col("right") / n, F.col("agree") / (n * n), F.col("major") / n, F.col("same") / n
    lift = lambda base, none: F.when(base < 1, (acc - base) / (1 - base)).otherwise(none)
    return total.join(both, by).select(
        *by, "rows", acc.alias("accuracy"), lift(e, F.lit(0.0)).alias("kappa"), lift(m, F.lit(0.0)).alias("kappa_m"), lift(t, F.lit(None)).alias("kappa_t")
    )


def fill_concept(log: DataFrame) -> DataFrame:
    """The log with a null concept replaced by the last one known."""
    return running(log, concept=("last", F.col("concept")))


def concept_pairs(log: DataFrame, model: str = "active_model") -> DataFrame:
    """Recall, precision and F1 of every observed pair of true concept and model; nulls are filled first."""
    n = fill_concept(log).groupBy("stream_id", "concept", F.col(model).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    gt = F.sum("n").over(Window.partitionBy("stream_id", "concept"))
    own = F.sum("n").over(Window.partitionBy("stream_id", "model"))
    r, p = F.col("n") / gt, F.col("n") / own
    return n.select("stream_id", "concept", "model", "n", gt.alias("gt_n"), own.alias("model_n"), r.alias("recall"), p.alias("precision"), (2 * r * p / (r + p)).alias("f1"))


def _best(metric: str, tie: str) -> Column:
    """Row with the largest metric; the smallest partner wins ties."""
    return F.max_by(F.struct(F.col(tie), "recall", "precision", "f1"), F.struct(F.col(metric), -F.col(tie)))


def best_models(pairs: DataFrame) -> DataFrame:
    """For each true concept its models of best recall, precision and F1, with their values."""
    got = pairs.groupBy("stream_id", "concept").agg(_best("recall", "model").alias("r"), _best("precision", "model").alias("p"), _best("f1", "model").alias("f"))
    return got.select(
        "stream_id", "concept",
        F.col("r.model").alias("recall_model"), F.col("r.recall").alias("max_recall"), F.col("r.precision").alias("precision_at_max_recall"),
        F.col("p.model").alias("precision_model"), F.col("p.precision").alias("max_precision"), F.col("p.recall").alias("recall_at_max_precision"),
        F.col("f.model").alias("f1_model"), F.col("f.f1").alias("max_f1"),
    )


def concept_summary(pairs: DataFrame) -> DataFrame:
    """Macro means over the true concepts, and how many models are good ones (both above 0.75)."""
    per = best_models(pairs)
    good = (F.col("max_recall") > 0.75) & (F.col("precision_at_max_recall") > 0.75)
    return per.groupBy("stream_id").agg(
        F.avg("max_recall").alias("mean_recall"), F.avg("max_precision").alias("mean_precision"), F.avg("max_f1").alias("mean_f1"),
        F.count_if(good).alias("good_models"), F.avg(good.cast("double")).alias("good_ratio"),
    )


def weighted_models(pairs: DataFrame) -> DataFrame:
    """For each model its best concept by F1, and the means over models weighted by their share of the rows."""
    per = pairs.groupBy("stream_id", "model").agg(_best("f1", "concept").alias("b"), F.max("recall").alias("recall"), F.max("precision").alias("precision"), F.first("model_n").alias("model_n"))
    share = F.col("model_n") / F.sum("model_n").over(Window.partitionBy("stream_id"))
    per = per.withColumn("share", share)
    return per.groupBy("stream_id").agg(
        F.sum(F.col("share") * F.col("recall")).alias("weighted_recall"),
        F.sum(F.col("share") * F.col("precision")).alias("weighted_precision"),
        F.sum(F.col("share") * F.col("b.f1")).alias("weighted_f1"),
        F.count(F.lit(1)).alias("models"),
    )


def after_drift(log: DataFrame, follow: int) -> DataFrame:
    """Rows in [d, d + follow] of any true drift d but the stream's first."""
    numbered = running(log, dn=("sum", F.col("drift_occured")))
    last = running(numbered, at=("max", F.when((F.col("drift_occured") == 1) & (F.col("dn") > 1), F.col("example"))))
    return last.where(F.col("example") - F.col("at") <= follow).drop("dn", "at")


def after_detection(log: DataFrame, follow: int, near: int = 1000) -> DataFrame:
    """Rows in [c, c + follow] of a detected change c that are also within `near` rows of a true drift."""
    at = {k: ("max", F.when(F.col(flag) == 1, F.col("example"))) for k, flag in (("c", "change_detected"), ("d", "drift_occured"))}
    rows = running(log, **at)
    return rows.where((F.col("example") - F.col("c") <= follow) & (F.col("example") - F.col("d") <= near)).drop("c", "d")


def accuracy(log: DataFrame) -> DataFrame:
    return log.groupBy(*S).agg(F.count(F.lit(1)).alias("rows"), F.avg("is_correct").alias("accuracy"))


def runs(log: DataFrame, column: str) -> DataFrame:
    """Gaps and islands: [first, last] of every run of one value; null values have no run."""
    # The row before as a struct: a stream's first row has none, which is not the same as one that holds null.
    prev = running(log, prev=("before", F.struct(F.col(column).alias("v"))))
    same = F.col("prev").isNotNull() & F.col(column).eqNullSafe(F.col("prev.v"))
    marked = running(prev.withColumn("new", (~same).cast("int")), run=("sum", F.col("new")))
    return marked.where(F.col(column).isNotNull()).groupBy("stream_id", "run", F.col(column).alias("value")).agg(F.min("example").alias("first"), F.max("example").alias("last")).drop("run")


def repair_models(log: DataFrame, deleted: DataFrame, model: str = "active_model") -> DataFrame:
    """repair_model: a deleted model's rows take the next surviving model of the stream.

    deleted: (stream_id, model). The rest of a stream that ends in a deleted model stays null.
    """
    gone = deleted.select("stream_id", F.col("model").alias(model), F.lit(True).alias("gone")).distinct()
    kept = F.when(F.col("gone").isNull(), F.col(model))
    rows = log.join(gone, ["stream_id", model], "left")
    return running(rows, repair_model=("next", kept)).drop("gone")


def resolve_merges(merges: DataFrame, rounds: int = 64) -> DataFrame:
    """(stream_id, old, model): the model that each merged one ends in, following merges of merges.

    merges: (stream_id, old, new), acyclic. Pointer jumping: each round doubles the distance followed.
    """
    found = merges.select("stream_id", "old", F.col("new").alias("model")).distinct()
    for _ in range(rounds):
        step = found.select("stream_id", F.col("old").alias("model"), F.col("model").alias("further"))
        joined = found.join(step, ["stream_id", "model"], "left")
        if joined.where(F.col("further").isNotNull()).isEmpty():
            return found
        found = joined.select("stream_id", "old", F.coalesce("further", "model").alias("model"))
    raise ValueError("merges form a cycle")


def discrimination(log: DataFrame, similarity: DataFrame, model: str = "active_model", skip: int = 250, edge: int = 50) -> DataFrame:
    """By how many standard deviations the active model stands out from the others, per stream.

    similarity: (stream_id, example, model, sim), null for unknown. Values are scaled by the minimum and the 90th
    percentile of all but the first `skip` rows that have any, and clipped. A chunk is a run of the active model without
    `edge` rows at each end; its difference to another model is divided by the mean of both standard deviations and
    weighted by the chunk's share of all rows in chunks.
    """
    o = _order()
    new = (~F.col(model).eqNullSafe(F.lag(model).over(o))).cast("int")
    rows = log.withColumn("new", new).select("stream_id", "example", F.col(model).alias("active"), "new")
    rows = rows.withColumn("chunk", F.sum("new").over(_so_far()))
    inner = (F.lag("chunk", edge).over(o) == F.col("chunk")) & (F.lead("chunk", edge).over(o) == F.col("chunk"))
    rows = rows.withColumn("inner", F.coalesce(inner, F.lit(False)))

    known = similarity.where(F.col("sim").isNotNull())
    numbered = known.withColumn("at", F.dense_rank().over(Window.partitionBy("stream_id").orderBy("example")))
    scale = numbered.where(F.col("at") > skip).groupBy("stream_id").agg(F.min("sim").alias("lo"), F.percentile("sim", F.lit(0.9)).alias("hi"))
    sims = known.join(rows.where("inner"), ["stream_id", "example"]).join(scale, "stream_id")
    sims = sims.withColumn("z", F.least(F.greatest((F.col("sim") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)))
    per = sims.groupBy("stream_id", "chunk", "active", "model").agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.stddev_samp("z").alias("sd"))
    own = per.where("model = active").select("stream_id", "chunk", F.col("mean").alias("own_mean"), F.col("sd").alias("own_sd"))
    size = rows.where("inner").groupBy("stream_id", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    share = F.col("rows") / F.sum("rows").over(Window.partitionBy("stream_id"))
    size = size.withColumn("share", share)
    other = per.where("model <> active and n > 1").join(own, ["stream_id", "chunk"]).join(size, ["stream_id", "chunk"])
    spread = (F.col("sd") + F.col("own_sd")) / 2
    other = other.withColumn("d", F.when(spread > 0, (F.col("mean") - F.col("own_mean")) / spread).otherwise(0.0) * F.col("share"))
    per_chunk = other.groupBy("stream_id", "chunk").agg(F.avg("d").alias("d"))
    return per_chunk.groupBy("stream_id").agg(F.sum("d").alias("mean_discrimination"), F.count(F.lit(1)).alias("chunks"))


def online_confusion(log: DataFrame, model: str = "active_model") -> DataFrame:
    """Running counts of the row's pair of concept and model, and running recall, precision and F1 of that pair."""
    rows = fill_concept(log).select("stream_id", "example", "concept", F.col(model).alias("model"))
    for name, keys in (("n", ["concept", "model"]), ("gt_n", ["concept"]), ("model_n", ["model"])):
        rows = running(rows, ["stream_id", *keys], **{name: ("sum", F.lit(1))})
    return rows.select("*", (F.col("n") / F.col("gt_n")).alias("recall"), (F.col("n") / F.col("model_n")).alias("precision"), (2.0 * F.col("n") / (F.col("gt_n") + F.col("model_n"))).alias("f1"))


def log_summary(log: DataFrame, columns: list[str]) -> DataFrame:
    """Last, largest and mean value of some columns of each stream."""
    aggs = []
    for c in columns:
        aggs += [F.max_by(c, "example").alias(f"last_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    return log.groupBy(*S).agg(*aggs)


def similarity_record(rows: DataFrame, value: str, kept: int = 49) -> DataFrame:
    """Mean and sample stdev (0 for one) of the newest `kept` similarities of each state."""
    w = Window.partitionBy("stream_id", "state").orderBy("example").rowsBetween(-(kept - 1), 0)
    return rows.select("stream_id", "state", "example", F.avg(value).over(w).alias("mean"), F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0)).alias("stdev"))


def traces(rows: DataFrame, value: str, every: int = 10, smooth: int = 7) -> DataFrame:
    """Every n-th value of each state's series with its rolling mean; series do not run into each other."""
    w = Window.partitionBy("stream_id", "state").orderBy("example").rowsBetween(-(smooth - 1), 0)
    thin = rows.where(F.col("example") % every == 0)
    return thin.select("stream_id", "state", "example", F.col(value).alias("value"), F.when(F.count(F.lit(1)).over(w) == smooth, F.avg(value).over(w)).alias("smooth"))


def result_record(log: DataFrame, similarity: DataFrame, horizons: tuple[int, ...] = (50, 250, 500)) -> DataFrame:
    """One row per stream: the kappas of the whole run and of each horizon, concept matching and discrimination."""
    out = kappas(log)
    for kind, rows in (("drift", after_drift), ("driftdetect", after_detection)):
        for h in horizons:
            k = kappas(rows(log, h))
            out = out.join(k.select(*S, *[F.col(c).alias(f"{kind}_{h}_{c}") for c in k.columns if c not in (*S, "rows")]), S, "left")
    pairs = concept_pairs(log)
    return out.join(concept_summary(pairs), S, "left").join(weighted_models(pairs), S, "left").join(discrimination(log, similarity), S, "left")
