"""Further queries of the catalogue: records, traces, divergences and the other weightings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import infotheory as info
from ..operators import evaluation, fingerprints, transitions, weights, windows
from .catalog import (
    BIN, ENT, HIST, MI, RUNS, SIMS, SO_FAR, STATS, TRANS, W, _frame, _other, _SCALE, _sims, _stats, query,
)
from .tables import MODELS, experience_log


@query(f"{RUNS}, h AS (SELECT stream_id, example, active_model, new FROM runs) SELECT stream_id, example AS first, active_model AS value FROM h WHERE new = 1")
def run_starts(spark, d):
    return evaluation.runs(experience_log(spark, d), "active_model").select("stream_id", "first", "value")


@query(
    f""", f AS (SELECT *, last_value(concept IGNORE NULLS) {SO_FAR} AS fc FROM log),
    c AS (SELECT stream_id, example, fc AS concept, active_model AS model, count(*) OVER (PARTITION BY stream_id, fc, active_model ORDER BY example) AS n,
      count(*) OVER (PARTITION BY stream_id, fc ORDER BY example) AS gt_n, count(*) OVER (PARTITION BY stream_id, active_model ORDER BY example) AS model_n FROM f)
    SELECT *, n / CAST(gt_n AS DOUBLE) AS recall, n / CAST(model_n AS DOUBLE) AS precision, 2.0 * n / (gt_n + model_n) AS f1 FROM c"""
)
def online_confusion(spark, d):
    return evaluation.online_confusion(experience_log(spark, d))


@query(" SELECT stream_id, max_by(value, example) AS last_value, max(value) AS max_value, avg(value) AS mean_value, max_by(k, example) AS last_k, max(k) AS max_k, avg(k) AS mean_k FROM log GROUP BY 1")
def log_summary(spark, d):
    return evaluation.log_summary(experience_log(spark, d), ["value", "k"])


def _series(spark, d):
    return _sims(experience_log(spark, d)).select("stream_id", "example", F.col("model").alias("state"), F.col("sim").alias("value"))


@query(f"{SIMS}, w AS (SELECT stream_id, model AS state, example, avg(sim) OVER o AS mean, coalesce(stddev_samp(sim) OVER o, 0) AS stdev FROM sims WINDOW o AS (PARTITION BY stream_id, model ORDER BY example ROWS BETWEEN 48 PRECEDING AND CURRENT ROW)) SELECT stream_id, state, example, round(mean, 8) AS mean, round(stdev, 8) AS stdev FROM w WHERE example > 0")
def similarity_record(spark, d):
    r = evaluation.similarity_record(_series(spark, d), "value").where("example > 0")
    return r.select("stream_id", "state", "example", F.round("mean", 8).alias("mean"), F.round("stdev", 8).alias("stdev"))


@query(f"{SIMS}, t AS (SELECT stream_id, model AS state, example, sim FROM sims WHERE example % 10 = 0) SELECT stream_id, state, example, sim AS value, round(CASE WHEN count(*) OVER o = 7 THEN avg(sim) OVER o END, 6) AS smooth FROM t WINDOW o AS (PARTITION BY stream_id, state ORDER BY example ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def probability_trace(spark, d):
    return evaluation.traces(_series(spark, d), "value").withColumn("smooth", F.round("smooth", 6))


@query(f" SELECT stream_id, example, round(corr(k, b) {_frame(W)}, 6) AS lag_correlation FROM (SELECT *, lag(k) {SO_FAR} AS b FROM log) QUALIFY example >= 6")
def lag_correlation(spark, d):
    return windows.lag_correlation(experience_log(spark, d), "k", 1, W).where("example >= 6").withColumn("lag_correlation", F.round("lag_correlation", 6))


@query()
def result_record(spark, d):
    log = experience_log(spark, d)
    return evaluation.result_record(log, _sims(log).select("stream_id", "example", "model", "sim"))


@query(f"{STATS}, s AS (SELECT *, source || '.' || feature AS signal FROM stats) SELECT a.state, a.signal AS a, b.signal AS b, count(*) AS n, covar_samp(a.value, b.value) AS covariance FROM s a JOIN s b ON a.stream_id = b.stream_id AND a.example = b.example AND a.signal < b.signal GROUP BY 1, 2, 3")
def signal_covariance(spark, d):
    s = _stats(spark, d).withColumn("signal", F.concat_ws(".", "source", "feature"))
    a = s.select("stream_id", "example", "state", F.col("signal").alias("a"), F.col("value").alias("va"))
    b = s.select("stream_id", "example", F.col("signal").alias("b"), F.col("value").alias("vb"))
    # A row's signals are a fixed catalogue, so a row meets few others.
    j = a.join(b, ["stream_id", "example"]).where("a < b")
    return j.groupBy("state", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("va", "vb").alias("covariance"))


@query(
    f"""{STATS}, j AS (SELECT a.state AS a, b.state AS b, a.source, a.feature, a.mean AS m1, a.stdev AS s1, b.mean AS m2, b.stdev AS s2 FROM fp a JOIN fp b ON a.source = b.source AND a.feature = b.feature AND a.state < b.state WHERE a.stdev > 0 AND b.stdev > 0),
    k AS (SELECT *, ln(s2 / s1) + (s1 * s1 + (m1 - m2) ** 2) / (2 * s2 * s2) - 0.5 AS kl, ln(s1 / s2) + (s2 * s2 + (m1 - m2) ** 2) / (2 * s1 * s1) - 0.5 AS kl_swap FROM j)
    SELECT a, b, source, feature, kl, kl_swap, kl + kl_swap AS kl_sym, ln(sqrt(s1 * s1 + s2 * s2)) - (ln(s1) + ln(s2)) / 2 AS js FROM k"""
)
def state_divergences(spark, d):
    fp = fingerprints.fingerprints(_stats(spark, d), ["state"]).where("stdev > 0")
    a = fp.select("source", "feature", F.col("state").alias("a"), F.col("mean").alias("m1"), F.col("stdev").alias("s1"))
    b = fp.select("source", "feature", F.col("state").alias("b"), F.col("mean").alias("m2"), F.col("stdev").alias("s2"))
    return info.divergences(a.join(b, ["source", "feature"]).where("a < b")).select("a", "b", "source", "feature", "kl", "kl_swap", "kl_sym", "js")


@query(
    f"""{STATS}, w AS (SELECT *, seen / CAST(sum(seen) OVER (PARTITION BY source, feature) AS DOUBLE) AS w FROM fp WHERE stdev > 0)
    SELECT source, feature, log2(4 * sqrt(sum(w * (stdev * stdev + mean * mean)) - sum(w * mean) ** 2)) - sum(w * log2(4 * stdev)) AS gain FROM w GROUP BY 1, 2"""
)
def uniform_information_gain(spark, d):
    fp = fingerprints.fingerprints(_stats(spark, d), ["state"]).where("stdev > 0")
    return info.uniform_information_gain(fp.select("source", "feature", F.col("mean").alias("mu"), F.col("stdev").alias("sigma"), "seen"), ["source", "feature"])


@query(
    f"""{MI}, g AS (SELECT es.source, es.feature, em.e AS h, sum(es.e * es.total / em.total) AS given FROM es JOIN em USING (source, feature) GROUP BY es.source, es.feature, em.e)
    SELECT source, feature, round(h, 9) AS h, round(given, 9) AS given, round(h - given, 9) AS gain, round(CASE WHEN h > 0 THEN (h - given) / h ELSE 0 END, 9) AS share FROM g"""
)
def conditional_entropy(spark, d):
    c = info.conditional_entropy(fingerprints.histogram_fingerprints(_stats(spark, d), ["state"]), ["source", "feature"], "state")
    return c.select("source", "feature", *[F.round(x, 9).alias(x) for x in ("h", "given", "gain", "share")])


@query(
    f"""{_SCALE}, grp AS (SELECT state, source, feature, mean, stdev, seen FROM fp UNION ALL SELECT CAST((state + 1) % {MODELS} AS INTEGER), source, feature, mean, stdev, seen FROM fp),
    b0 AS (SELECT source, feature, (mean - low) / width AS m, stdev / width AS i, seen / CAST(sum(seen) OVER (PARTITION BY source, feature) AS DOUBLE) AS w, sd / width AS o FROM fp JOIN sc USING (source, feature)),
    b1 AS (SELECT *, sum(w * m) OVER (PARTITION BY source, feature) AS mu FROM b0), b2 AS (SELECT source, feature, sum(w * (m - mu) ** 2) AS bt, sum(w * i * i) AS inn, max(o) ** 2 AS ov FROM b1 GROUP BY 1, 2),
    o0 AS (SELECT state, source, feature, (mean - low) / width AS m, stdev / width AS i, seen / CAST(sum(seen) OVER (PARTITION BY state, source, feature) AS DOUBLE) AS w, sd / width AS o FROM grp JOIN sc USING (source, feature)),
    o1 AS (SELECT *, sum(w * m) OVER (PARTITION BY state, source, feature) AS mu FROM o0), o2 AS (SELECT state, source, feature, sum(w * (m - mu) ** 2) AS bt, sum(w * i * i) AS inn, max(o) ** 2 AS ov FROM o1 GROUP BY 1, 2, 3),
    o3 AS (SELECT source, feature, avg(CASE WHEN inn > 0 THEN bt / inn WHEN ov > 0 THEN bt / ov ELSE 0 END) AS own FROM o2 GROUP BY 1, 2)
    SELECT source, feature, CASE WHEN states < 2 THEN scale ELSE greatest(CASE WHEN inn > 0 THEN bt / inn WHEN ov > 0 THEN bt / ov ELSE 0 END, own) * scale END AS weight
    FROM (SELECT source, feature FROM norm) LEFT JOIN sc USING (source, feature) LEFT JOIN b2 USING (source, feature) LEFT JOIN o3 USING (source, feature)"""
)
def fisher_within_weights(spark, d):
    s = _stats(spark, d)
    return weights.fisher_overall(fingerprints.fingerprints(s, ["state"]), _other(s), fingerprints.normaliser(s), within=True)


@query(
    f"""{STATS}, nw AS (SELECT source, feature, hi - lo AS width, lo AS low FROM norm WHERE hi > lo),
    s AS (SELECT source, feature, width, low, avg(stdev / width) AS spread, count(*) AS states FROM fp JOIN nw USING (source, feature) GROUP BY 1, 2, 3, 4), sc AS (SELECT *, CASE WHEN spread > 0 THEN 0.01 / greatest(spread, 0.01) END AS scale FROM s),
    b AS (SELECT source, feature, stddev_pop((mean - low) / width * scale) AS bt FROM fp JOIN sc USING (source, feature) GROUP BY 1, 2),
    grp AS (SELECT state, source, feature, mean FROM fp UNION ALL SELECT CAST((state + 1) % {MODELS} AS INTEGER), source, feature, mean FROM fp),
    o AS (SELECT source, feature, avg(sd) AS own FROM (SELECT state, source, feature, stddev_pop((mean - low) / width * scale) AS sd FROM grp JOIN sc USING (source, feature) GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT source, feature, CASE WHEN states < 2 THEN scale ELSE greatest(bt, own) END AS weight FROM (SELECT source, feature FROM norm) LEFT JOIN sc USING (source, feature) LEFT JOIN b USING (source, feature) LEFT JOIN o USING (source, feature)"""
)
def original_weights(spark, d):
    s = _stats(spark, d)
    return weights.original(fingerprints.fingerprints(s, ["state"]), _other(s), fingerprints.normaliser(s))


_X = "(abs(z) / sqrt(2))"
_T = f"(1 / (1 + {_X} * 0.3275911))"
_TAIL = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{_X} * {_X}))"


@query(
    f"""{_SCALE}, g AS (SELECT state, source, feature, (mean - low) / width AS mu, greatest(fp.stdev / width, 0.01) AS sigma, CAST(seen AS DOUBLE) AS seen FROM fp JOIN sc USING (source, feature)),
    e AS (SELECT *, range AS edge, (range / 10.0 - mu) / sigma AS z FROM g, range(11)), c AS (SELECT *, CASE WHEN edge = 0 THEN 0.0 WHEN edge = 10 THEN 1.0 WHEN z >= 0 THEN 1 - {_TAIL} / 2 ELSE {_TAIL} / 2 END AS cdf FROM e),
    h AS (SELECT state, source, feature, edge - 1 AS bin, seen * (cdf - lag(cdf) OVER (PARTITION BY state, source, feature ORDER BY edge)) AS n FROM c QUALIFY edge > 0),
    s AS (SELECT *, sum(n) OVER (PARTITION BY state, source, feature) AS t FROM h), es AS (SELECT state, source, feature, any_value(t) AS total, {ENT} AS e FROM s GROUP BY 1, 2, 3),
    mg0 AS (SELECT source, feature, bin, sum(n) AS n FROM h GROUP BY 1, 2, 3), mg AS (SELECT *, sum(n) OVER (PARTITION BY source, feature) AS t FROM mg0), em AS (SELECT source, feature, any_value(t) AS total, {ENT} AS e FROM mg GROUP BY 1, 2),
    mi AS (SELECT source, feature, greatest(em.e - sum(es.e * es.total / em.total), 0) AS mi FROM es JOIN em USING (source, feature) GROUP BY source, feature, em.e)
    SELECT source, feature, round(mi * scale, 7) AS weight FROM (SELECT source, feature FROM norm) LEFT JOIN sc USING (source, feature) LEFT JOIN mi USING (source, feature)"""
)
def gaussian_mi_weights(spark, d):
    s = _stats(spark, d)
    w = weights.gaussian_mi(fingerprints.fingerprints(s, ["state"]), fingerprints.normaliser(s))
    return w.select("source", "feature", F.round("weight", 7).alias("weight"))


@query(
    f"""{HIST}, pl AS (SELECT stream_id, example, source, feature, CAST({BIN} AS INTEGER) AS bin FROM stats JOIN (SELECT source, feature, lo, hi FROM norm) USING (source, feature)),
    tt AS (SELECT state, source, feature, sum(n) AS total FROM h GROUP BY 1, 2, 3)
    SELECT p.stream_id, p.example, tt.state, sum(ln(coalesce(CAST(h.n AS DOUBLE), 0.5) / tt.total)) AS log_probability FROM pl p JOIN tt USING (source, feature)
    LEFT JOIN h ON h.state = tt.state AND h.source = p.source AND h.feature = p.feature AND h.bin = p.bin GROUP BY 1, 2, 3"""
)
def histogram_log_probability(spark, d):
    s = _stats(spark, d)
    return weights.log_probability(s, fingerprints.histogram_fingerprints(s, ["state"]), fingerprints.normaliser(s))


@query(f"{STATS}, e AS (SELECT *, example // 500 AS epoch FROM stats), m AS (SELECT *, max(epoch) OVER (PARTITION BY stream_id) AS newest FROM e) SELECT stream_id, source, feature, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS stdev, count(*) AS seen FROM m WHERE source NOT IN ('errors', 'labels', 'predictions') OR epoch = newest GROUP BY 1, 2, 3")
def evolved_fingerprints(spark, d):
    s = _stats(spark, d).withColumn("epoch", F.floor(F.col("example") / 500))
    return fingerprints.evolved_fingerprints(s, ["stream_id"], ["errors", "labels", "predictions"])


@query(f"{TRANS} SELECT stream_id, CASE WHEN src = 3 THEN 1 ELSE src END AS src, CASE WHEN dst = 3 THEN 1 ELSE dst END AS dst, sum(n) AS n FROM t GROUP BY 1, 2, 3")
def merged_transitions(spark, d):
    log = experience_log(spark, d)
    mapping = log.select("stream_id").distinct().withColumns({"old": F.lit(3), "model": F.lit(1)})
    return transitions.remapped(transitions.counts(log), mapping)
