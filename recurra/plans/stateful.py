"""Queries of stateful and iterative operators; SQL cannot express them, tests compare them with brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import metafeatures as meta
from ..streaming.adwin import Adwin
from ..streaming.replay import replay
from ..streaming.sketch import sketch_groups
from ..streaming.system import Options
from ..streaming.tree import HoeffdingTree
from .catalog import query
from .tables import event_stream, experience_log, table


def labelled_stream(spark, d) -> DataFrame:
    """Event streams with features (value, k) and whether the event is a click or a view as the label."""
    e = event_stream(spark, d)
    concept = F.floor(F.col("example") / 500) % 3
    # Each concept has its own rule on the same features, so behaviour recurs.
    rule = F.when(concept == 0, F.col("k") < 50).when(concept == 1, F.col("value") < 20).otherwise(F.col("k") >= 50)
    return e.select("stream_id", "example", F.array("value", "k").alias("x"), rule.cast("int").alias("y"), concept.cast("string").alias("concept"))


def _run(system: str):
    def run(spark, d):
        return replay(labelled_stream(spark, d), system, Options(classes=2))

    return run


for _name, _system in (("adaptive_run", "CC"), ("adaptive_run_map", "cc_map"), ("fingerprint_run", "fingerprint"), ("lower_bound_run", "lower_bound"), ("middle_bound_run", "middle_bound"), ("upper_bound_run", "upper_bound"), ("weighted_majority_run", "dwm"), ("adaptive_forest_run", "arf")):
    query(None, _name)(_run(_system))


def adwin_log(rows: DataFrame, value: str, delta: float = 0.05) -> DataFrame:
    """(stream_id, example, width, mean, change) of an ADWIN over each stream; change: -1 down, 1 up, 0 none."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, a, out = pdf.sort_values("example"), Adwin(delta), []
        for e, v in zip(pdf["example"].tolist(), pdf["v"].tolist(), strict=True):
            cut = v == v and a.add(float(v))
            out.append((int(key[0]), e, a.width, a.mean, (1 if a.after > a.before else -1) if cut else 0))
        return pd.DataFrame(out, columns=["stream_id", "example", "width", "mean", "change"])

    own = rows.select("stream_id", "example", F.col(value).cast("double").alias("v"))
    return own.groupBy("stream_id").applyInPandas(run, "stream_id long, example long, width long, mean double, change int")


@query()
def adwin_detections(spark, d):
    return adwin_log(experience_log(spark, d), "is_correct")


def tree_log(rows: DataFrame, classes: int) -> DataFrame:
    """Per stream the prequential accuracy and shape of a Hoeffding tree, and its rules as SQL."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("example")
        t, right = HoeffdingTree(classes, len(pdf["x"].iloc[0])), 0
        for x, y in zip(pdf["x"], pdf["y"].tolist(), strict=True):
            v = np.asarray(x, float)
            right += t.predict_one(v) == y
            t.fit_one(v, int(y))
        m = t.measure()
        return pd.DataFrame([(int(key[0]), len(pdf), right / len(pdf), m["nodes"], m["depth"], t.evolution, t.sql())], columns=["stream_id", "rows", "accuracy", "nodes", "depth", "evolution", "rules"])

    return rows.select("stream_id", "example", "x", "y").groupBy("stream_id").applyInPandas(run, "stream_id long, rows long, accuracy double, nodes int, depth int, evolution int, rules string")


@query()
def hoeffding_tree_log(spark, d):
    return tree_log(labelled_stream(spark, d), 2)


@query()
def sketch_rows(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label"), "embedding")
    return sketch_groups(e, "label", "embedding", 10)


def window_functions(rows: DataFrame, value: str, size: int) -> DataFrame:
    """(stream_id, block, rows, mi, imf_0..2, permutation_entropy) of each full or last block of `size` rows."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("example")["v"].to_numpy(float)
        return pd.DataFrame([(int(key[0]), int(key[1]), len(v), meta.auto_mi(v), *meta.imf_entropies(v), meta.permutation_entropy(v))], columns=["stream_id", "block", "rows", "mi", "imf_0", "imf_1", "imf_2", "permutation_entropy"])

    own = rows.select("stream_id", "example", F.floor(F.col("example") / size).alias("block"), F.col(value).cast("double").alias("v"))
    return own.groupBy("stream_id", "block").applyInPandas(run, "stream_id long, block long, rows long, mi double, imf_0 double, imf_1 double, imf_2 double, permutation_entropy double")


@query()
def window_information(spark, d):
    return window_functions(experience_log(spark, d), "k", 100)


@query(name="circular_pattern")
def circular_pattern(spark, d):
    from ..operators.compose import recurrence_pattern, segments

    order = [f"c{i}" for i in recurrence_pattern(4, 3, 1, dropoff=0.5, forward=2, noise=0.1)]
    return segments(spark, {"c0": 100, "c1": 120, "c2": 80, "c3": 100}, order)


@query(name="generated_stream")
def generated_stream(spark, d):
    from ..operators import compose
    from ..sources.generators import concepts

    rows = concepts(spark, "STAGGERS", 1, 500)
    names = ["STAGGERS_0", "STAGGERS_1", "STAGGERS_2"]
    pieces = compose.segments(spark, dict.fromkeys(names, 500), names * 2).withColumn("stream_id", F.lit(0).cast("long"))
    places = spark.range(3000).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("example"))
    return compose.compose(rows, compose.locate(places, pieces))
