"""Scores that depend on all rows of a stream so far, cut into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from recurra.operators import evaluation, transitions

LOG = "stream_id long, example long, y int, p int, is_correct int, concept int, active_model int, drift_occured int, change_detected int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = []
    for s, n in ((0, 90), (1, 7), (None, 12)):
        for i in range(n):
            y, p = rng.randrange(3), rng.randrange(3)
            rows.append((s, i, y, p, int(y == p), rng.choice([None, None, 0, 1]), rng.randrange(3), int(rng.random() < 0.1), int(rng.random() < 0.1)))
    return spark.createDataFrame(rows, LOG).repartition(3).cache()


def results(log):
    gone = log.sparkSession.createDataFrame([(0, 2), (1, 0)], "stream_id long, model int")
    tables = {
        "kappas": evaluation.kappas(log), "filled": evaluation.fill_concept(log), "drift": evaluation.after_drift(log, 3), "detection": evaluation.after_detection(log, 5, 9),
        "runs": evaluation.runs(log, "concept"), "repaired": evaluation.repair_models(log, gone), "online": evaluation.online_confusion(log), "steps": transitions.counts(log),
    }
    return {k: sorted((str(sorted(r.asDict().items())) for r in t.collect())) for k, t in tables.items()}


def test_blocks_do_not_change_results(log, monkeypatch):
    whole = results(log)
    monkeypatch.setattr(evaluation, "BLOCK", 4)
    assert results(log) == whole and all(whole.values())


def test_running_equals_the_plain_form(log, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK", 5)
    got = evaluation.running(
        log, total=("sum", F.col("y")), top=("max", F.when(F.col("y") == 2, F.col("example"))), last=("last", F.col("concept")), prev=("before", F.col("concept")), ahead=("next", F.col("concept"))
    ).collect()
    for s in (0, 1, None):
        rows = sorted((r for r in got if r.stream_id == s), key=lambda r: r.example)
        for i, r in enumerate(rows):
            known = [q.concept for q in rows[: i + 1] if q.concept is not None]
            later = [q.concept for q in rows[i:] if q.concept is not None]
            twos = [q.example for q in rows[: i + 1] if q.y == 2]
            assert r.total == sum(q.y for q in rows[: i + 1]) and r.top == (max(twos) if twos else None)
            assert r.last == (known[-1] if known else None) and r.ahead == (later[0] if later else None)
            assert r.prev == (rows[i - 1].concept if i else None)
    with pytest.raises(ValueError):
        evaluation.running(log, x=("other", F.col("y")))


def test_no_frame_runs_to_the_end_of_a_block(log):
    # Spark goes through such a frame anew for every row: a block of 262,144 rows took that many squared.
    rows = log.sparkSession.range(100_000).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("example"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v"))
    got = evaluation.running(rows, ahead=("next", F.col("v")))
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()
    wrong = F.coalesce(F.col("ahead") != F.floor(F.col("example") / 1000) * 1000 + 999, F.lit(True))
    assert got.count() == 100_000 and got.where(wrong).isEmpty()
