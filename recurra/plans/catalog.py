"""Stream queries over the relational tables, each with its SQL; names are those of the query registry."""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import infotheory as info
from ..functions import vectors as vec
from ..operators import compose, evaluation, fingerprints, transitions, weights, windows
from ..sources import generators
from .tables import LOG_SQL, MODELS, SEGMENT, STREAM_SQL, event_stream, experience_log, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None, log: bool = True):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE[key] = f"WITH {LOG_SQL}{sql}" if log else sql
        return f

    return add


W = 50  # rows of a window in these queries

# --- streams ---


@query(f"WITH {STREAM_SQL} SELECT stream_id, example, value, k, y FROM stream", log=False)
def stream_index(spark, d):
    return event_stream(spark, d)


def _segments(log: DataFrame) -> DataFrame:
    n = log.groupBy("stream_id").agg(F.max("example").alias("last"))
    pieces = n.select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / SEGMENT))).alias("segment"))
    lengths = pieces.withColumns({"length": F.lit(SEGMENT).cast("long"), "concept": F.concat(F.lit("c"), (F.col("segment") % 3).cast("string"))})
    return compose.laid_out(lengths)


@query(
    f""" SELECT stream_id, example, CASE WHEN example % {SEGMENT} <> {SEGMENT - 1} THEN example // {SEGMENT} END AS segment,
    CASE WHEN example % {SEGMENT} <> {SEGMENT - 1} THEN 'c' || CAST((example // {SEGMENT}) % 3 AS VARCHAR) END AS concept FROM log"""
)
def segment_ground_truth_range_join(spark, d):
    log = event_stream(spark, d)
    return compose.locate(log.select("stream_id", "example"), _segments(log), exclusive=True).select("stream_id", "example", "segment", "concept")


def _u(*parts: str) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"


@query(
    f""", s AS (SELECT stream_id, example, example // {SEGMENT} AS seg, max(example // {SEGMENT}) OVER (PARTITION BY stream_id) AS last_seg,
      example % {SEGMENT} AS since, {SEGMENT} - example % {SEGMENT} AS left_rows, {_u("'5'", "CAST(stream_id AS VARCHAR)", "CAST(example AS VARCHAR)")} AS u FROM log)
    SELECT stream_id, example, 'c' || CAST((CASE
      WHEN seg > 0 AND u < CASE WHEN since < 20.0 THEN 0.5 - since / 40.0 ELSE 0.0 END THEN seg - 1
      WHEN seg < last_seg AND u < CASE WHEN left_rows < 20.0 THEN 0.5 - left_rows / 40.0 ELSE 0.0 END THEN seg + 1
      ELSE seg END) % 3 AS VARCHAR) AS source_concept FROM s"""
)
def gradual_drift_mix(spark, d):
    log = event_stream(spark, d)
    pieces = _segments(log)
    located = compose.locate(log.select("stream_id", "example"), pieces)
    return compose.gradual(located, pieces, 40, 5).select("stream_id", "example", "source_concept")


@query(
    f""" SELECT stream_id, example, CAST(CASE WHEN {_u("'9'", "CAST(stream_id AS VARCHAR)", "CAST(example AS VARCHAR)")} < 0.1
      THEN floor({_u("'10'", "CAST(stream_id AS VARCHAR)", "CAST(example AS VARCHAR)")} * 5) ELSE y END AS INTEGER) AS y FROM log"""
)
def label_noise(spark, d):
    return compose.label_noise(event_stream(spark, d), [0, 1, 2, 3, 4], 0.1, 9).select("stream_id", "example", "y")


def _g(seed: int, name: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}:{name}:' || CAST(example AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0)"


@query(
    f"""WITH r AS (SELECT range AS example FROM range(3000)), v AS (SELECT example, floor({_g(3, "size")} * 3) AS s, floor({_g(3, "color")} * 3) AS c, floor({_g(3, "shape")} * 3) AS h FROM r)
    SELECT example, s AS size, c AS color, h AS shape, CAST(c = 1 OR h = 0 AS INTEGER) AS y FROM v""",
    log=False,
)
def stagger_labels(spark, d):
    x = F.col("x")
    return generators.stagger(spark, 3000, 1, 3).select("example", x[0].alias("size"), x[1].alias("color"), x[2].alias("shape"), "y")


@query(
    f"""WITH r AS (SELECT range AS example FROM range(3000)), v AS (SELECT example, {_g(4, "x0")} * 10 AS a, {_g(4, "x1")} * 10 AS b, {_g(4, "x2")} * 10 AS c FROM r)
    SELECT example, a, b, c, CAST(a + b <= 7.0 AS INTEGER) AS y FROM v""",
    log=False,
)
def sea_labels(spark, d):
    x = F.col("x")
    return generators.sea(spark, 3000, 2, 4).select("example", x[0].alias("a"), x[1].alias("b"), x[2].alias("c"), "y")


def _hyperplane_sql(seed: int = 6, features: int = 8) -> str:
    rng = random.Random(seed)
    w = [rng.random() for _ in range(features)]
    total = " + ".join(f"h{i} * {x!r}" for i, x in enumerate(w))
    half = f"({' + '.join(repr(x) for x in w)}) / 2"
    cols = ", ".join(f"{_g(seed, f'h{i}')} AS h{i}" for i in range(features))
    return f"""WITH r AS (SELECT range AS example FROM range(3000)), v AS (SELECT example, {cols}, {_g(seed, "flip")} AS f FROM r)
    SELECT example, CAST(CASE WHEN f < 0.05 THEN 1 - CAST({total} >= {half} AS INTEGER) ELSE CAST({total} >= {half} AS INTEGER) END AS INTEGER) AS y FROM v"""


@query(_hyperplane_sql(), log=False)
def hyperplane_labels(spark, d):
    return generators.hyperplane(spark, 3000, 6).select("example", "y")


@query(
    f"""WITH r AS (SELECT range AS example FROM range(3000)), v AS (SELECT example, 20000 + 130000 * {_g(8, "salary")} AS salary, floor(20 + 61 * {_g(8, "age")}) AS age FROM r)
    SELECT example, salary, age, CAST(NOT CASE WHEN age < 40 THEN salary BETWEEN 50000 AND 100000 WHEN age < 60 THEN salary BETWEEN 75000 AND 125000 ELSE salary BETWEEN 25000 AND 75000 END AS INTEGER) AS y FROM v""",
    log=False,
)
def agrawal_labels(spark, d):
    x = F.col("x")
    return generators.agrawal(spark, 3000, 1, 8).select("example", x[0].alias("salary"), x[2].alias("age"), "y")


# --- evaluation ---

SO_FAR = "OVER (PARTITION BY stream_id ORDER BY example)"


@query(
    f""" SELECT stream_id, example, CAST(sum(is_correct) {SO_FAR} AS BIGINT) AS right_sum, CAST(sum(1 - is_correct) {SO_FAR} AS BIGINT) AS wrong_sum,
    sum(is_correct) {SO_FAR} / CAST(example + 1 AS DOUBLE) AS overall_accuracy FROM log"""
)
def prequential_running_accuracy(spark, d):
    return evaluation.running_accuracy(experience_log(spark, d))


def _kappa_sql(pred: str) -> str:
    return f""", b AS (SELECT *, CAST(lag(y, 1, 0) {SO_FAR} = y AS INTEGER) AS same FROM log),
    t AS (SELECT stream_id, count(*) AS n, avg(is_correct) AS acc, avg(same) AS pt FROM b GROUP BY 1),
    g AS (SELECT stream_id, y AS c, count(*) AS gt FROM log GROUP BY 1, 2), q AS (SELECT stream_id, {pred} AS c, count(*) AS pr FROM log GROUP BY 1, 2),
    e AS (SELECT stream_id, sum(gt * coalesce(pr, 0)) AS agree, max(gt) AS major FROM g LEFT JOIN q USING (stream_id, c) GROUP BY 1),
    z AS (SELECT stream_id, n AS rows, acc AS accuracy, agree / CAST(n AS DOUBLE) / n AS e, major / CAST(n AS DOUBLE) AS m, pt FROM t JOIN e USING (stream_id))
    SELECT stream_id, rows, accuracy, CASE WHEN e < 1 THEN (accuracy - e) / (1 - e) ELSE 0 END AS kappa,
      CASE WHEN m < 1 THEN (accuracy - m) / (1 - m) ELSE 0 END AS kappa_m, CASE WHEN pt < 1 THEN (accuracy - pt) / (1 - pt) END AS kappa_t FROM z"""


@query(_kappa_sql("p"))
def accuracy_kappas(spark, d):
    return evaluation.kappas(experience_log(spark, d))


@query(_kappa_sql("y"))
def accuracy_kappas_label_only(spark, d):
    return evaluation.kappas(experience_log(spark, d), label_only=True)


PAIRS = f""", f AS (SELECT *, last_value(concept IGNORE NULLS) {SO_FAR} AS fc FROM log),
pairs AS (SELECT stream_id, fc AS concept, active_model AS model, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY stream_id, fc) AS BIGINT) AS gt_n,
  CAST(sum(count(*)) OVER (PARTITION BY stream_id, active_model) AS BIGINT) AS model_n FROM f GROUP BY 1, 2, 3),
scored AS (SELECT *, n / CAST(gt_n AS DOUBLE) AS recall, n / CAST(model_n AS DOUBLE) AS precision, 2.0 * n / (gt_n + model_n) AS f1 FROM pairs)"""


@query(f"{PAIRS} SELECT stream_id, concept, model, n FROM pairs")
def confusion_pairs(spark, d):
    return evaluation.concept_pairs(experience_log(spark, d)).select("stream_id", "concept", "model", "n")


@query(f"{PAIRS} SELECT * FROM scored")
def concept_recall_precision_f1(spark, d):
    return evaluation.concept_pairs(experience_log(spark, d))


BEST = f"""{PAIRS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY stream_id, concept ORDER BY recall DESC, model) AS r,
  row_number() OVER (PARTITION BY stream_id, concept ORDER BY precision DESC, model) AS p, row_number() OVER (PARTITION BY stream_id, concept ORDER BY f1 DESC, model) AS f FROM scored),
best AS (SELECT a.stream_id, a.concept, a.model AS recall_model, a.recall AS max_recall, a.precision AS precision_at_max_recall, b.model AS precision_model,
  b.precision AS max_precision, b.recall AS recall_at_max_precision, c.model AS f1_model, c.f1 AS max_f1
  FROM ranked a JOIN ranked b USING (stream_id, concept) JOIN ranked c USING (stream_id, concept) WHERE a.r = 1 AND b.p = 1 AND c.f = 1)"""


@query(f"{BEST} SELECT * FROM best")
def gt_best_match(spark, d):
    return evaluation.best_models(evaluation.concept_pairs(experience_log(spark, d)))


@query(
    f"""{BEST} SELECT stream_id, avg(max_recall) AS mean_recall, avg(max_precision) AS mean_precision, avg(max_f1) AS mean_f1,
    count(*) FILTER (max_recall > 0.75 AND precision_at_max_recall > 0.75) AS good_models,
    avg(CAST(max_recall > 0.75 AND precision_at_max_recall > 0.75 AS INTEGER)) AS good_ratio FROM best GROUP BY 1"""
)
def concept_summary(spark, d):
    return evaluation.concept_summary(evaluation.concept_pairs(experience_log(spark, d)))


@query(
    f"""{PAIRS}, m AS (SELECT stream_id, model, max(f1) AS f1, max(recall) AS recall, max(precision) AS precision, any_value(model_n) AS w FROM scored GROUP BY 1, 2),
    s AS (SELECT *, w / CAST(sum(w) OVER (PARTITION BY stream_id) AS DOUBLE) AS share FROM m)
    SELECT stream_id, sum(share * recall) AS weighted_recall, sum(share * precision) AS weighted_precision, sum(share * f1) AS weighted_f1, count(*) AS models FROM s GROUP BY 1"""
)
def system_weighted_match(spark, d):
    return evaluation.weighted_models(evaluation.concept_pairs(experience_log(spark, d)))


def _post_drift(follow: int) -> None:
    sql = f""", n AS (SELECT *, sum(drift_occured) {SO_FAR} AS dn FROM log), x AS (SELECT *, max(CASE WHEN drift_occured = 1 AND dn > 1 THEN example END) {SO_FAR} AS since FROM n)
    SELECT stream_id, count(*) AS rows, avg(is_correct) AS accuracy FROM x WHERE example - since <= {follow} GROUP BY 1"""

    def run(spark, d):
        return evaluation.accuracy(evaluation.after_drift(experience_log(spark, d), follow))

    query(sql, f"post_drift_accuracy_{follow}")(run)


for _follow in (50, 250, 500):
    _post_drift(_follow)


@query(
    f""", x AS (SELECT *, max(CASE WHEN change_detected = 1 THEN example END) {SO_FAR} AS c, max(CASE WHEN drift_occured = 1 THEN example END) {SO_FAR} AS dr FROM log)
    SELECT stream_id, count(*) AS rows, avg(is_correct) AS accuracy FROM x WHERE example - c <= 50 AND example - dr <= 1000 GROUP BY 1"""
)
def post_detection_accuracy(spark, d):
    return evaluation.accuracy(evaluation.after_detection(experience_log(spark, d), 50))


RUNS = f""", c AS (SELECT *, CASE WHEN active_model IS NOT DISTINCT FROM lag(active_model) {SO_FAR} THEN 0 ELSE 1 END AS new FROM log),
runs AS (SELECT *, sum(new) {SO_FAR} AS run FROM c)"""


@query(f"{RUNS} SELECT stream_id, any_value(active_model) AS value, min(example) AS first, max(example) AS last FROM runs GROUP BY stream_id, run")
def run_ranges(spark, d):
    return evaluation.runs(experience_log(spark, d), "active_model")


@query(f" SELECT stream_id, example, last_value(concept IGNORE NULLS) {SO_FAR} AS concept FROM log")
def ffill_concept(spark, d):
    return evaluation.fill_concept(experience_log(spark, d)).select("stream_id", "example", "concept")


@query(
    """ SELECT stream_id, example, first_value(CASE WHEN active_model <> 2 THEN active_model END IGNORE NULLS)
    OVER (PARTITION BY stream_id ORDER BY example ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS repair_model FROM log"""
)
def repair_bfill(spark, d):
    log = experience_log(spark, d)
    deleted = log.select("stream_id").distinct().withColumn("model", F.lit(2))
    return evaluation.repair_models(log, deleted).select("stream_id", "example", "repair_model")


@query(""" SELECT stream_id, CAST(CASE active_model WHEN 3 THEN 1 WHEN 2 THEN 1 ELSE active_model END AS INTEGER) AS model, count(*) AS n FROM log GROUP BY 1, 2""")
def merged_models(spark, d):
    log = experience_log(spark, d)
    merges = log.select("stream_id").distinct().crossJoin(spark.createDataFrame([(3, 2), (2, 1)], "old int, new int"))
    found = evaluation.resolve_merges(merges)
    rows = log.join(found.select("stream_id", F.col("old").alias("active_model"), F.col("model").alias("merged")), ["stream_id", "active_model"], "left")
    return rows.groupBy("stream_id", F.coalesce("merged", "active_model").alias("model")).agg(F.count(F.lit(1)).alias("n"))


SIMS = f", sims AS (SELECT stream_id, example, active_model, m AS model, ((k + 17 * m) % 100) / 100.0 + CASE WHEN m = active_model THEN 0.3 ELSE 0.0 END AS sim FROM log, (SELECT CAST(range AS INTEGER) AS m FROM range({MODELS})))"


def _sims(log: DataFrame) -> DataFrame:
    m = F.explode(F.array(*[F.lit(i) for i in range(MODELS)]))
    rows = log.select("stream_id", "example", "active_model", "k", m.alias("model"))
    sim = ((F.col("k") + 17 * F.col("model")) % 100) / 100.0 + F.when(F.col("model") == F.col("active_model"), 0.3).otherwise(0.0)
    return rows.select("stream_id", "example", "active_model", "model", sim.alias("sim"))


@query(
    f"""{RUNS}{SIMS}, i AS (SELECT *, coalesce(lag(run, 50) {SO_FAR} = run AND lead(run, 50) {SO_FAR} = run, false) AS inner_row FROM runs),
    sc AS (SELECT stream_id, min(sim) AS lo, quantile_cont(sim, 0.9) AS hi FROM sims WHERE example >= 250 GROUP BY 1),
    z AS (SELECT s.stream_id, i.run, i.active_model AS active, s.model, least(greatest((sim - lo) / (hi - lo), 0.0), 1.0) AS z FROM sims s JOIN i USING (stream_id, example) JOIN sc USING (stream_id) WHERE inner_row),
    per AS (SELECT stream_id, run, active, model, count(*) AS n, avg(z) AS mean, stddev_samp(z) AS sd FROM z GROUP BY 1, 2, 3, 4),
    size AS (SELECT stream_id, run, count(*) / CAST(sum(count(*)) OVER (PARTITION BY stream_id) AS DOUBLE) AS share FROM i WHERE inner_row GROUP BY 1, 2),
    o AS (SELECT stream_id, run, mean AS om, sd AS osd FROM per WHERE model = active),
    d AS (SELECT p.stream_id, p.run, avg(CASE WHEN (sd + osd) / 2 > 0 THEN (mean - om) / ((sd + osd) / 2) ELSE 0 END * share) AS d
      FROM per p JOIN o USING (stream_id, run) JOIN size USING (stream_id, run) WHERE model <> active AND n > 1 GROUP BY 1, 2)
    SELECT stream_id, sum(d) AS mean_discrimination, count(*) AS chunks FROM d GROUP BY 1"""
)
def discrimination(spark, d):
    log = experience_log(spark, d)
    return evaluation.discrimination(log, _sims(log).select("stream_id", "example", "model", "sim"))


# --- windows ---


def _frame(w: int, start: int = 0, stop: int = 0) -> str:
    last = f"{stop} PRECEDING" if stop else "CURRENT ROW"
    return f"OVER (PARTITION BY stream_id ORDER BY example ROWS BETWEEN {w - 1 - start} PRECEDING AND {last})"


@query(f" SELECT stream_id, example, CASE WHEN count(*) {_frame(100)} = 100 THEN avg(is_correct) {_frame(100)} END AS rolling_mean FROM log")
def rolling_mean_100(spark, d):
    return windows.rolling_mean(experience_log(spark, d), "is_correct", 100)


def _moments(x: str, over: str) -> str:
    n = f"count(*) {over}"
    return f"""avg({x}) {over} AS mean, coalesce(stddev_samp({x}) {over}, 0) AS stdev,
    CASE WHEN {n} < 3 OR var_pop({x}) {over} <= 1e-14 THEN 0 ELSE skewness({x}) {over} * ({n} - 2) / sqrt({n} * ({n} - 1.0)) END AS skew,
    CASE WHEN {n} < 2 OR var_pop({x}) {over} <= 1e-14 THEN -3 ELSE kurtosis_pop({x}) {over} END AS kurtosis"""


@query(f", m AS (SELECT stream_id, example, {_moments('k', _frame(W))} FROM log) SELECT stream_id, example, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis FROM m WHERE example > 2")
def rolling_moments(spark, d):
    m = windows.moments(experience_log(spark, d), "k", W).where("example > 2")
    return m.select("stream_id", "example", *[F.round(c, p).alias(c) for c, p in (("mean", 6), ("stdev", 6), ("skew", 5), ("kurtosis", 5))])


@query(
    f""", t AS (SELECT *, k - lag(k) {SO_FAR} AS dk FROM log), u AS (SELECT *, CAST(dk * lag(dk) {SO_FAR} < 0 AS INTEGER) AS turn FROM t)
    SELECT stream_id, example, CASE WHEN count(*) {_frame(W)} < 3 THEN 0.0 ELSE coalesce(sum(turn) {_frame(W, 2)}, 0) / CAST(count(*) {_frame(W)} AS DOUBLE) END AS turning_point_rate FROM u"""
)
def turning_point_rate(spark, d):
    return windows.turning_point_rate(experience_log(spark, d), "k", W)


ACF = f""", l AS (SELECT stream_id, example, list(k) {_frame(W)} AS a FROM log),
q AS (SELECT *, CAST(len(a) AS DOUBLE) AS n, list_avg(a) AS m FROM l),
c AS (SELECT *, list_sum(list_transform(a, lambda x: (x - m) * (x - m))) AS c0,
  list_sum(list_transform(range(1, len(a)), lambda i: (a[i] - m) * (a[i + 1] - m))) AS c1, list_sum(list_transform(range(1, len(a) - 1), lambda i: (a[i] - m) * (a[i + 2] - m))) AS c2 FROM q),
acf AS (SELECT stream_id, example, n, CASE WHEN n > 1 AND c0 > 1e-12 THEN c1 / c0 ELSE 0 END AS a1, CASE WHEN n > 2 AND c0 > 1e-12 THEN c2 / c0 ELSE 0 END AS a2 FROM c)"""


@query(f"{ACF} SELECT stream_id, example, round(a1, 6) AS acf_1, round(a2, 6) AS acf_2 FROM acf")
def acf_lags(spark, d):
    return windows.autocorrelations(experience_log(spark, d), "k", W).select("stream_id", "example", F.round("acf_1", 6).alias("acf_1"), F.round("acf_2", 6).alias("acf_2"))


@query(
    f"""{ACF}, u AS (SELECT *, CASE WHEN n > 1 THEN a1 * n / (n - 1) ELSE 0 END AS u1, CASE WHEN n > 2 THEN a2 * n / (n - 2) ELSE 0 END AS u2 FROM acf)
    SELECT stream_id, example, round(u1, 6) AS pacf_1, round(CASE WHEN n > 2 AND abs(1 - u1 * u1) > 1e-12 THEN (u2 - u1 * u1) / (1 - u1 * u1) ELSE 0 END, 5) AS pacf_2 FROM u WHERE example >= 10"""
)
def pacf_lags(spark, d):
    a = windows.autocorrelations(experience_log(spark, d), "k", W).where("example >= 10")
    return a.select("stream_id", "example", F.round("pacf_1", 6).alias("pacf_1"), F.round("pacf_2", 5).alias("pacf_2"))


@query(f", e AS (SELECT stream_id, example, example - lag(example) {SO_FAR} AS error_distance FROM log WHERE is_correct = 0) SELECT * FROM e WHERE error_distance IS NOT NULL")
def error_distances(spark, d):
    return windows.error_distances(experience_log(spark, d))


@query(f" SELECT stream_id, example, avg(k) {_frame(20 + W, 0, 20)} AS stable_mean FROM log")
def stable_window_mean(spark, d):
    return windows.stable_mean(experience_log(spark, d), "k", W, 20)


@query(f" SELECT stream_id, example, round(regr_slope(k, value) {_frame(W)}, 6) AS slope, round(corr(k, value) {_frame(W)}, 6) AS correlation FROM log WINDOW o AS (PARTITION BY stream_id) QUALIFY example >= 5")
def running_regression(spark, d):
    r = windows.running_regression(experience_log(spark, d), "value", "k", W).where("example >= 5")
    return r.select("stream_id", "example", F.round("slope", 6).alias("slope"), F.round("correlation", 6).alias("correlation"))


# --- normalisers, fingerprints ---

EVERY = 25
_SOURCES = {"value": "value", "k": "k", "labels": "CAST(y AS DOUBLE)", "predictions": "CAST(p AS DOUBLE)", "errors": "CAST(is_correct AS DOUBLE)"}
_LONG = " UNION ALL ".join(f"SELECT stream_id, example, active_model, '{n}' AS source, {x} AS v FROM log" for n, x in _SOURCES.items())
_BY = f"OVER (PARTITION BY stream_id, source ORDER BY example ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW)"
STATS = f""", long AS ({_LONG}), ws AS (SELECT stream_id, example, active_model, source, avg(v) {_BY} AS mean, coalesce(stddev_samp(v) {_BY}, 0) AS stdev FROM long),
stats AS (SELECT stream_id, example, active_model AS state, source, 'mean' AS feature, mean AS value FROM ws WHERE example % {EVERY} = {EVERY - 1}
  UNION ALL SELECT stream_id, example, active_model, source, 'stdev', stdev FROM ws WHERE example % {EVERY} = {EVERY - 1}),
norm AS (SELECT source, feature, min(value) AS lo, max(value) AS hi, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev, count(*) AS seen FROM stats GROUP BY 1, 2),
fp AS (SELECT state, source, feature, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev, count(*) AS seen FROM stats GROUP BY 1, 2, 3)"""


def _stats(spark, d) -> DataFrame:
    log = experience_log(spark, d)
    s = windows.window_stats(log, ["value", "k"], W, EVERY, ignore=("skew", "kurtosis"))
    # Weightings read these few rows several times; kept so that the frames are computed once. Lost parts are computed again.
    return s.join(log.select("stream_id", "example", F.col("active_model").alias("state")), ["stream_id", "example"]).persist()


@query(f"{STATS} SELECT stream_id, example, source, feature, round(value, 6) AS value FROM stats")
def window_stats_long(spark, d):
    return _stats(spark, d).select("stream_id", "example", "source", "feature", F.round("value", 6).alias("value"))


@query(f" SELECT stream_id, example, min(value) {SO_FAR} AS lo, max(value) {SO_FAR} AS hi, CASE WHEN max(value) {SO_FAR} > min(value) {SO_FAR} THEN (value - min(value) {SO_FAR}) / (max(value) {SO_FAR} - min(value) {SO_FAR}) ELSE 0.5 END AS scaled FROM log")
def running_minmax_norm(spark, d):
    return fingerprints.running_scaled(experience_log(spark, d), "value")


@query(f"{STATS} SELECT source, feature, row_number() OVER (ORDER BY source, feature) - 1 AS signal, lo, hi, mean, stdev, seen FROM norm")
def normaliser(spark, d):
    return fingerprints.normaliser(_stats(spark, d)).select("source", "feature", F.col("signal").cast("long").alias("signal"), "lo", "hi", "mean", "stdev", "seen")


@query(
    f"""{STATS} SELECT stream_id, example, string_agg(printf('%.5f', CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END), ';' ORDER BY source, feature) AS vector
    FROM stats JOIN norm USING (source, feature) GROUP BY 1, 2"""
)
def flat_vector(spark, d):
    s = _stats(spark, d)
    v = fingerprints.flat_vectors(s, ["stream_id", "example"], fingerprints.normaliser(s))
    return v.select("stream_id", "example", F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", x)), ";").alias("vector"))


@query(f"{STATS} SELECT * FROM fp")
def fingerprint_mean_stdev(spark, d):
    return fingerprints.fingerprints(_stats(spark, d), ["state"])


BIN = "CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 10)), 9) ELSE 9 END"
HIST = f"{STATS}, h AS (SELECT state, source, feature, CAST({BIN} AS INTEGER) AS bin, count(*) AS n FROM stats JOIN (SELECT source, feature, lo, hi FROM norm) USING (source, feature) GROUP BY 1, 2, 3, 4)"


@query(f"{HIST} SELECT * FROM h")
def fingerprint_histogram(spark, d):
    return fingerprints.histogram_fingerprints(_stats(spark, d), ["state"])


@query(
    """, r AS (SELECT stream_id, min(k) AS lo, max(k) AS hi FROM log GROUP BY 1), a AS (SELECT min(lo) AS l, max(hi) AS u FROM r),
    h AS (SELECT stream_id, lo, hi, CASE WHEN hi > lo THEN least(floor((k - lo) / ((hi - lo) / 20)), 19) ELSE 19 END AS bin, count(*) AS n FROM log JOIN r USING (stream_id) GROUP BY 1, 2, 3, 4),
    m AS (SELECT stream_id, n, lo + (bin + 0.5) * (hi - lo) / 20 AS mid, l, u FROM h, a)
    SELECT stream_id, CAST(least(floor((mid - l) / ((u - l) / 8)), 7) AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 2"""
)
def rebin_histogram(spark, d):
    h = info.histogram(experience_log(spark, d), ["stream_id"], "k", 20).withColumn("old", F.lit(20))
    return info.rebin(h, ["stream_id"], 8)


ENT = "sum(CASE WHEN n > 0 THEN -(n / t) * log2(n / t) ELSE 0 END)"


@query(f"{HIST}, s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY state, source, feature) AS DOUBLE) AS t FROM h) SELECT state, source, feature, CAST(any_value(t) AS BIGINT) AS total, {ENT} AS entropy FROM s GROUP BY 1, 2, 3")
def histogram_entropy(spark, d):
    return info.entropy(fingerprints.histogram_fingerprints(_stats(spark, d), ["state"]), ["state", "source", "feature"])


@query(f", c AS (SELECT stream_id, y, count(*) AS n FROM log GROUP BY 1, 2), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY stream_id) AS DOUBLE) AS t FROM c) SELECT stream_id, CAST(any_value(t) AS BIGINT) AS total, {ENT} AS entropy FROM s GROUP BY 1")
def class_entropy(spark, d):
    return info.entropy(experience_log(spark, d).groupBy("stream_id", "y").agg(F.count(F.lit(1)).alias("n")), ["stream_id"])


MI = f"""{HIST}, s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY state, source, feature) AS DOUBLE) AS t FROM h), es AS (SELECT state, source, feature, any_value(t) AS total, {ENT} AS e FROM s GROUP BY 1, 2, 3),
mg AS (SELECT source, feature, bin, sum(n) AS n, CAST(sum(sum(n)) OVER (PARTITION BY source, feature) AS DOUBLE) AS t FROM h GROUP BY 1, 2, 3), em AS (SELECT source, feature, any_value(t) AS total, {ENT} AS e FROM mg GROUP BY 1, 2),
mi AS (SELECT source, feature, greatest(em.e - sum(es.e * es.total / em.total), 0) AS mi FROM es JOIN em USING (source, feature) GROUP BY source, feature, em.e)"""


@query(f"{MI} SELECT source, feature, round(mi, 9) AS mi FROM mi")
def histogram_mi(spark, d):
    h = fingerprints.histogram_fingerprints(_stats(spark, d), ["state"])
    return info.mutual_information(h, ["source", "feature"], "state").select("source", "feature", F.round("mi", 9).alias("mi"))


@query(
    f"""{STATS}, w AS (SELECT *, seen / CAST(sum(seen) OVER (PARTITION BY source, feature) AS DOUBLE) AS w FROM fp WHERE stdev > 0)
    SELECT source, feature, 2.0470955851806957 + log2(sqrt(sum(w * (stdev * stdev + mean * mean)) - sum(w * mean) ** 2)) - sum(w * (2.0470955851806957 + log2(stdev))) AS gain FROM w GROUP BY 1, 2"""
)
def gaussian_information_gain(spark, d):
    fp = fingerprints.fingerprints(_stats(spark, d), ["state"]).where("stdev > 0")
    return info.gaussian_information_gain(fp.select("source", "feature", F.col("mean").alias("mu"), F.col("stdev").alias("sigma"), "seen"), ["source", "feature"])


@query(
    f"""{STATS} SELECT a.state AS a, b.state AS b, a.source, a.feature, ln(b.stdev / a.stdev) + (a.stdev ** 2 + (a.mean - b.mean) ** 2) / (2 * b.stdev ** 2) - 0.5 AS kl
    FROM fp a JOIN fp b ON a.source = b.source AND a.feature = b.feature AND a.state < b.state WHERE a.stdev > 0 AND b.stdev > 0"""
)
def gaussian_divergence(spark, d):
    fp = fingerprints.fingerprints(_stats(spark, d), ["state"]).where("stdev > 0")
    a = fp.select("source", "feature", F.col("state").alias("a"), F.col("mean").alias("m1"), F.col("stdev").alias("s1"))
    b = fp.select("source", "feature", F.col("state").alias("b"), F.col("mean").alias("m2"), F.col("stdev").alias("s2"))
    j = a.join(b, ["source", "feature"]).where("a < b")
    return j.select("a", "b", "source", "feature", info.gaussian_kl(F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2")).alias("kl"))


def _other(stats: DataFrame) -> DataFrame:
    """Fingerprints of a state while another was active: here its neighbour's."""
    return fingerprints.fingerprints(stats.withColumn("observed_under", F.col("state")).withColumn("state", (F.col("state") + 1) % MODELS), ["state", "observed_under"])


_SCALE = f"""{STATS}, nw AS (SELECT source, feature, hi - lo AS width, lo AS low, stdev AS sd FROM norm WHERE hi > lo),
sc AS (SELECT source, feature, width, low, sd, 0.01 / greatest(sum(seen * stdev / width) / sum(seen), 0.01) AS scale, count(*) AS states FROM fp JOIN nw n USING (source, feature) GROUP BY 1, 2, 3, 4, 5)""".replace("sum(seen * stdev / width)", "sum(seen * fp.stdev / width)")
FISHER = f"""{_SCALE}, grp AS (SELECT state, source, feature, mean, seen FROM fp UNION ALL
  SELECT CAST((state + 1) % {MODELS} AS INTEGER), source, feature, mean, seen FROM fp),
fb0 AS (SELECT source, feature, (mean - low) / width AS m, seen / CAST(sum(seen) OVER (PARTITION BY source, feature) AS DOUBLE) AS w, sd / width AS o FROM fp JOIN sc USING (source, feature)),
fb1 AS (SELECT *, sum(w * m) OVER (PARTITION BY source, feature) AS mu FROM fb0), fb AS (SELECT source, feature, CASE WHEN max(o) > 0 THEN sum(w * (m - mu) ** 2) / max(o) ** 2 ELSE 0 END AS between_f FROM fb1 GROUP BY 1, 2),
fo0 AS (SELECT state, source, feature, (mean - low) / width AS m, seen / CAST(sum(seen) OVER (PARTITION BY state, source, feature) AS DOUBLE) AS w, sd / width AS o FROM grp JOIN sc USING (source, feature)),
fo1 AS (SELECT *, sum(w * m) OVER (PARTITION BY state, source, feature) AS mu FROM fo0), fo2 AS (SELECT state, source, feature, CASE WHEN max(o) > 0 THEN sum(w * (m - mu) ** 2) / max(o) ** 2 ELSE 0 END AS f FROM fo1 GROUP BY 1, 2, 3),
fo AS (SELECT source, feature, avg(f) AS own FROM fo2 GROUP BY 1, 2),
wts AS (SELECT source, feature, CASE WHEN states < 2 THEN scale ELSE greatest(between_f, own) * scale END AS weight FROM (SELECT source, feature FROM norm) LEFT JOIN sc USING (source, feature) LEFT JOIN fb USING (source, feature) LEFT JOIN fo USING (source, feature))"""


@query(f"{FISHER} SELECT source, feature, weight FROM wts")
def fisher_overall_weights(spark, d):
    s = _stats(spark, d)
    return weights.fisher_overall(fingerprints.fingerprints(s, ["state"]), _other(s), fingerprints.normaliser(s))


@query(f"{FISHER}, c AS (SELECT source, feature, coalesce(weight, min(weight) OVER (), 0.01) AS weight FROM wts) SELECT source, feature, weight, CAST(row_number() OVER (ORDER BY weight DESC, source, feature) AS INTEGER) AS rank FROM c")
def feature_weight_rank(spark, d):
    return weights.completed(fisher_overall_weights(spark, d))


@query(f"{MI.replace(STATS, _SCALE)} SELECT source, feature, round(mi * scale, 9) AS weight FROM (SELECT source, feature FROM norm) LEFT JOIN sc USING (source, feature) LEFT JOIN mi USING (source, feature)")
def histogram_mi_weights(spark, d):
    s = _stats(spark, d)
    w = weights.histogram_mi(s, fingerprints.normaliser(s), fingerprints.fingerprints(s, ["state"]))
    return w.select("source", "feature", F.round("weight", 9).alias("weight"))


# --- distances ---

VECS = f"""{STATS}, v AS (SELECT state, list(CASE WHEN hi > lo THEN (fp.mean - lo) / (hi - lo) ELSE 0.5 END ORDER BY source, feature) AS v FROM fp JOIN norm USING (source, feature) GROUP BY 1),
vp AS (SELECT a.state AS a, b.state AS b, a.v AS x, b.v AS z FROM v a JOIN v b ON a.state < b.state)"""


def _vector_pairs(spark, d) -> DataFrame:
    s = _stats(spark, d)
    fp = fingerprints.fingerprints(s, ["state"]).withColumnRenamed("mean", "value")
    v = fingerprints.flat_vectors(fp.select("state", "source", "feature", "value"), ["state"], fingerprints.normaliser(s))
    return v.select(F.col("state").alias("a"), F.col("vector").alias("x")).crossJoin(v.select(F.col("state").alias("b"), F.col("vector").alias("z"))).where("a < b")


@query(f"{VECS} SELECT a, b, 1 - list_inner_product(x, z) / sqrt(list_inner_product(x, x) * list_inner_product(z, z)) AS distance FROM vp")
def cosine_distance_states(spark, d):
    return _vector_pairs(spark, d).select("a", "b", vec.cosine_distance(F.col("x"), F.col("z")).alias("distance"))


@query(f"{VECS} SELECT a, b, list_distance(x, z) AS distance FROM vp")
def euclid_distance_states(spark, d):
    return _vector_pairs(spark, d).select("a", "b", vec.euclidean_distance(F.col("x"), F.col("z")).alias("distance"))


@query(
    f"""{VECS}, c AS (SELECT a, b, list_transform(x, lambda e: e - list_avg(x)) AS x, list_transform(z, lambda e: e - list_avg(z)) AS z FROM vp)
    SELECT a, b, 1 - list_inner_product(x, z) / sqrt(list_inner_product(x, x) * list_inner_product(z, z)) AS distance FROM c"""
)
def pearson_distance(spark, d):
    return _vector_pairs(spark, d).select("a", "b", vec.pearson_distance(F.col("x"), F.col("z")).alias("distance"))


@query(
    """SELECT vec_id, CASE WHEN e > 0 THEN u / e ELSE 0.0 END AS jaccard FROM (SELECT vec_id,
      CAST(len(list_filter(r, lambda i: i.a <> 0 OR i.b <> 0)) AS DOUBLE) AS e, CAST(len(list_filter(r, lambda i: (i.a <> 0 OR i.b <> 0) AND i.a <> i.b)) AS DOUBLE) AS u
    FROM (SELECT vec_id, list_transform(range(1, 33), lambda i: {'a': round(CAST(embedding[i] AS DOUBLE) * 4), 'b': round(CAST(embedding[i + 32] AS DOUBLE) * 4)}) AS r FROM embeddings))""",
    log=False,
)
def jaccard_distance(spark, d):
    e = table(spark, d, "embeddings")
    half = lambda at: F.transform(F.slice("embedding", at, 32), lambda x: F.round(x.cast("double") * 4))
    return e.select("vec_id", vec.jaccard_distance(half(1), half(33)).alias("jaccard"))


# --- transitions, priors, posteriors ---

TRANS = f", st AS (SELECT stream_id, lag(active_model) {SO_FAR} AS src, active_model AS dst FROM log), t AS (SELECT stream_id, src, dst, CAST(count(*) AS DOUBLE) AS n FROM st WHERE src IS NOT NULL GROUP BY 1, 2, 3), p AS (SELECT stream_id, src, dst, n / sum(n) OVER (PARTITION BY stream_id, src) AS p FROM t), states AS (SELECT DISTINCT stream_id, active_model AS state FROM log)"
SMOOTH = f"{TRANS}, sm AS (SELECT a.stream_id, a.state AS src, b.state AS dst, coalesce(p, 0) * 0.3 + 0.7 AS weight FROM states a JOIN states b USING (stream_id) LEFT JOIN p ON p.stream_id = a.stream_id AND p.src = a.state AND p.dst = b.state)"


@query(f"{TRANS} SELECT * FROM t")
def transition_counts(spark, d):
    return transitions.counts(experience_log(spark, d))


@query(f"{TRANS} SELECT * FROM p")
def transition_probs(spark, d):
    return transitions.probabilities(transitions.counts(experience_log(spark, d)))


def _states(log: DataFrame) -> DataFrame:
    return log.select("stream_id", F.col("active_model").alias("state")).distinct()


@query(f"{SMOOTH} SELECT stream_id, src, dst, weight, weight / sum(weight) OVER (PARTITION BY stream_id, src) AS prior FROM sm")
def smoothed_priors(spark, d):
    log = experience_log(spark, d)
    return transitions.smoothed(transitions.probabilities(transitions.counts(log)), _states(log))


HOPS = f"{TRANS}, c0 AS (SELECT stream_id, src, dst, n / sum(n) OVER (PARTITION BY stream_id, src) AS p FROM t WHERE src <> dst), h2 AS (SELECT a.stream_id, a.src, b.dst, sum(a.p * b.p) AS p FROM c0 a JOIN c0 b ON a.stream_id = b.stream_id AND a.dst = b.src GROUP BY 1, 2, 3)"


@query(f"{HOPS} SELECT * FROM h2")
def two_hop_priors(spark, d):
    c = transitions.probabilities(transitions.counts(experience_log(spark, d), changes_only=True))
    return transitions.hop(c, c)


POST = f"""{HOPS}, lk AS (SELECT stream_id, active_model AS state, avg(is_correct) AS likelihood FROM log GROUP BY 1, 2),
w AS (SELECT a.stream_id, b.state AS src, a.state AS dst, greatest(likelihood, 0.005) * greatest(coalesce(p.p, 0) * 0.3 + 0.7, coalesce(c0.p, 0) * 0.7 * 0.3 + 0.7, coalesce(h2.p, 0) * 0.49 * 0.3 + 0.7) AS weight
  FROM lk a JOIN states b USING (stream_id) LEFT JOIN p ON p.stream_id = a.stream_id AND p.src = b.state AND p.dst = a.state LEFT JOIN c0 ON c0.stream_id = a.stream_id AND c0.src = b.state AND c0.dst = a.state
  LEFT JOIN h2 ON h2.stream_id = a.stream_id AND h2.src = b.state AND h2.dst = a.state), q AS (SELECT *, weight / sum(weight) OVER (PARTITION BY stream_id, src) AS posterior FROM w)"""


@query(f"{POST} SELECT *, CAST(row_number() OVER (PARTITION BY stream_id, src ORDER BY posterior DESC, dst DESC) AS INTEGER) AS rank FROM q")
def posteriors_topk(spark, d):
    log = experience_log(spark, d)
    like = log.groupBy("stream_id", F.col("active_model").alias("state")).agg(F.avg("is_correct").alias("likelihood"))
    p = transitions.probabilities(transitions.counts(log))
    c = transitions.probabilities(transitions.counts(log, changes_only=True))
    return transitions.posteriors(like, [(p, 1.0), (c, 0.7), (transitions.hop(c, c), 0.7**2)])


@query(
    """, s AS (SELECT stream_id, active_model AS state, CAST(count(*) AS DOUBLE) AS n, avg(is_correct) AS u, var_samp(is_correct) AS v FROM log GROUP BY 1, 2),
    j AS (SELECT a.stream_id, a.state AS a, b.state AS b, 1 / (1 / a.n + 1 / b.n) AS m, ln(2 * ln(a.n + b.n) / 0.75) AS dd, a.v AS v, a.u AS u0, b.u AS u1 FROM s a JOIN s b ON a.stream_id = b.stream_id AND a.state <> b.state)
    SELECT stream_id, a, b, sqrt(2 / m * v * dd) + 2 / (3 * m) * dd AS bound, u1 > u0 AND u1 - u0 >= sqrt(2 / m * v * dd) + 2 / (3 * m) * dd AS swap FROM j"""
)
def hoeffding_swap_test(spark, d):
    s = experience_log(spark, d).groupBy("stream_id", "active_model").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("is_correct").alias("u"), F.var_samp("is_correct").alias("v"))
    a = s.select("stream_id", F.col("active_model").alias("a"), F.col("n").alias("n0"), F.col("u").alias("u0"), F.col("v").alias("v0"))
    b = s.select("stream_id", F.col("active_model").alias("b"), F.col("n").alias("n1"), F.col("u").alias("u1"))
    return transitions.swaps(a.join(b, "stream_id").where("a <> b")).select("stream_id", "a", "b", "bound", "swap")


@query(f"{SIMS} SELECT x.stream_id, x.model AS a, y.model AS b, count(*) AS n, round(corr(x.sim, y.sim), 9) AS correlation FROM sims x JOIN sims y ON x.stream_id = y.stream_id AND x.example = y.example AND x.model < y.model GROUP BY 1, 2, 3")
def state_pair_correlation(spark, d):
    s = _sims(experience_log(spark, d)).select("stream_id", "example", F.col("model").alias("state"), F.col("sim").alias("value"))
    return transitions.correlations(s).withColumn("correlation", F.round("correlation", 9))


@query(f"{SIMS} SELECT stream_id, model, count(*) AS n, avg(CAST(printf('%.4f', sim) AS DOUBLE)) AS mean_probability FROM sims WHERE example % 10 = 0 GROUP BY 1, 2")
def explode_packed_probs(spark, d):
    log = experience_log(spark, d)
    cell = F.array_join(F.array(*[F.format_string(f"{m}:%.4f", ((F.col("k") + 17 * m) % 100) / 100.0 + F.when(F.col("active_model") == m, 0.3).otherwise(0.0)) for m in range(MODELS)]), ";")
    packed = log.where("example % 10 = 0").select("stream_id", "example", cell.alias("cell"))
    rows = packed.select("stream_id", F.explode(F.str_to_map("cell", F.lit(";"), F.lit(":"))).alias("model", "v"))
    return rows.groupBy("stream_id", F.col("model").cast("int").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.try_to_number("v", F.lit("9.9999")).cast("double")).alias("mean_probability"))


@query(
    f"""{STATS}, e AS (SELECT source, feature, state, abs(stats.value - fp.mean) AS dist, fp.mean AS m, greatest(least(fp.stdev, 0.175), 0.015) AS s FROM stats JOIN fp USING (state, source, feature)),
    z AS (SELECT *, abs(dist / s) / sqrt(2) AS x FROM e), t AS (SELECT *, 1 / (1 + x * 0.3275911) AS t FROM z)
    SELECT source, feature, state, count(*) AS n, avg(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)) AS likelihood FROM t GROUP BY 1, 2, 3"""
)
def state_likelihoods(spark, d):
    s = _stats(spark, d)
    fp = fingerprints.fingerprints(s, ["state"])
    rows = s.join(fp.select("state", "source", "feature", "mean", "stdev"), ["state", "source", "feature"])
    like = vec.state_likelihood(F.col("value"), F.col("mean"), F.col("stdev"))
    return rows.groupBy("source", "feature", "state").agg(F.count(F.lit(1)).alias("n"), F.avg(like).alias("likelihood"))
