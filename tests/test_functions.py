"""Native functions and operators against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recurra.functions import infotheory as info
from recurra.functions import vectors as vec
from recurra.operators import compose, evaluation, fingerprints, transitions, weights, windows


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_distances(spark):
    a, b = arr(1, 2, 3), arr(2, 0, 1)
    x, y = np.array([1.0, 2, 3]), np.array([2.0, 0, 1])
    assert one(spark, vec.cosine_distance(a, b)) == pytest.approx(1 - x @ y / math.sqrt(x @ x * (y @ y)))
    assert one(spark, vec.euclidean_distance(a, b)) == pytest.approx(np.linalg.norm(x - y))
    assert one(spark, vec.pearson_distance(a, b)) == pytest.approx(1 - np.corrcoef(x, y)[0, 1])
    w = np.array([1.0, 0.5, 2.0])
    assert one(spark, vec.cosine_distance(a, b, arr(*w))) == pytest.approx(1 - (w * x) @ y / math.sqrt((w * x) @ x * ((w * y) @ y)))
    zero = arr(0, 0, 0)
    assert one(spark, vec.cosine_distance(zero, zero)) == 0 and one(spark, vec.cosine_distance(zero, a)) == 1
    assert one(spark, vec.jaccard_distance(arr(1, 0, 2), arr(1, 3, 0))) == pytest.approx(2 / 3)
    assert one(spark, vec.jmahal_distance(zero, zero)) == pytest.approx(1.0)


@pytest.mark.parametrize("z", [0.0, 0.3, -1.7, 4.0])
def test_normal_tail(spark, z):
    assert one(spark, vec.normal_tail(F.lit(z))) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)
    assert one(spark, vec.normal_cdf(F.lit(z))) == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=2e-7)


def test_rescaled(spark):
    lo, hi = F.lit(0.0), F.lit(4.0)
    cases = [(1.0, 0.25), (float("inf"), 1.0), (float("-inf"), 0.0), (float("nan"), 0.5)]
    for v, want in cases:
        assert one(spark, vec.rescaled(F.lit(v), lo, hi)) == want
    assert one(spark, vec.rescaled(F.lit(3.0), hi, hi)) == 0.5


def test_entropies(spark):
    assert one(spark, info.gaussian_entropy(F.lit(1.0))) == pytest.approx(2.05, abs=0.01)
    assert one(spark, info.gaussian_entropy(F.lit(0.5))) == pytest.approx(1.05, abs=0.01)
    g = spark.createDataFrame([("s", 1.75, 0.5, 100), ("s", 0.0, 0.5, 100)], "k string, mu double, sigma double, seen long")
    assert info.gaussian_information_gain(g, ["k"]).first().gain == pytest.approx(1, abs=0.1)
    c = spark.createDataFrame([("a", "x", 0, 10), ("a", "y", 1, 10)], "k string, g string, bin int, n long")
    assert info.mutual_information(c, ["k"], "g").first().mi == pytest.approx(1.0)
    n = info.gaussian_bins(spark.createDataFrame([("c", 1.0, 0.5, 1000.0)], "concept string, mu double, sigma double, seen double"), -1.0, 3.0, 10)
    got = np.array([r.n for r in n.orderBy("bin").collect()])
    want = np.histogram(np.random.default_rng(1).normal(1, 0.5, 1000), 10, (-1, 3))[0]
    assert (np.abs(got - want) <= np.maximum(0.3 * want, 20)).all()


def test_bins_at_the_edges(spark):
    for v, lo, hi, want in ((0.0, 0.0, 1.0, 0), (1.0, 0.0, 1.0, 4), (0.5, 0.0, 1.0, 2), (3.0, 3.0, 3.0, 4)):
        assert one(spark, info.bin_of(F.lit(v), F.lit(lo), F.lit(hi), 5)) == want


def groups(spark, data):
    rows = [("s", float(np.mean(g)), len(g), float(np.std(g)), float(np.std(np.concatenate(data)))) for g in data]
    return spark.createDataFrame(rows, "k string, mean double, seen long, sd double, overall double")


def test_fisher(spark):
    f = lambda d, w=None: weights.fisher(groups(spark, d), ["k"], w).first().fisher
    assert f([[1, 1.1, 0.9], [2, 2.1, 1.9], [3, 3.1, 2.9], [4, 4.1, 3.9]]) > 0.9
    assert f([[1, 2, 3], [11, 12, 13], [21, 22, 23], [31, 32, 33]]) > 0.9
    assert f([[1, 2, 3], [1, 2.1, 3], [1, 2, 3.1], [1, 2, 3]]) < 0.1
    small, large = [[1, 2, 3]] * 3 + [[10]], [[1, 2, 3]] * 3 + [[10] * 16]
    assert f(small) < f(large)
    assert f([[5.0], [5.0]]) == 0


def test_normaliser_and_vectors(spark):
    rows = []
    for obs, values in enumerate([(100, 25, 0.5, 50), (150, 25, 0.5, 25)]):
        for (s, f), v in zip([("Feature", "Mean"), ("Feature", "FI"), ("Labels", "Mean"), ("Labels", "FI")], values, strict=True):
            rows.append((obs, s, f, float(v)))
    stats = spark.createDataFrame(rows, "obs int, source string, feature string, value double")
    n = {(r.source, r.feature): r for r in fingerprints.normaliser(stats).collect()}
    assert (n["Feature", "Mean"].lo, n["Feature", "Mean"].hi) == (100, 150)
    assert n["Feature", "Mean"].stdev == pytest.approx(np.std([100, 150], ddof=1))
    assert [k for k, _ in sorted(n.items(), key=lambda x: x[1].signal)] == [("Feature", "FI"), ("Feature", "Mean"), ("Labels", "FI"), ("Labels", "Mean")]
    v = fingerprints.flat_vectors(stats, ["obs"], fingerprints.normaliser(stats)).orderBy("obs").collect()
    assert v[0].vector == [0.5, 0.0, 1.0, 0.5] and v[1].vector == [0.5, 1.0, 0.0, 0.5]


def test_evolution_and_plasticity(spark):
    rows = [(1, e, s, "mean", v) for e, s, v in ((0, "errors", 1.0), (0, "errors", 2.0), (1, "errors", 10.0), (0, "f0", 1.0), (1, "f0", 3.0))]
    stats = spark.createDataFrame(rows, "state int, epoch int, source string, feature string, value double")
    got = {r.source: r for r in fingerprints.evolved_fingerprints(stats, ["state"], ["errors"]).collect()}
    assert (got["errors"].mean, got["errors"].seen, got["f0"].mean) == (10.0, 1, 2.0)
    soft = {r.source: r for r in fingerprints.plastic_fingerprints(stats, ["state"]).collect()}
    assert soft["errors"].mean == pytest.approx((0.1 * 3 + 10) / 1.2)


def log(spark, y, p, **more):
    cols = {"stream_id": [0] * len(y), "example": list(range(len(y))), "y": y, "p": p, "is_correct": [int(a == b) for a, b in zip(y, p, strict=True)], **more}
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{k} int" for k in cols))


def test_published_kappa_with_labels_for_predictions(spark):
    """cmc: 722 and 751 rows of two classes; accuracy 0.617108 and kappa 0.233919 in the published table."""
    y = [0] * 722 + [1] * 751
    right = round(0.617108 * 1473)
    p = [v if i < right else 1 - v for i, v in enumerate(y)]
    k = evaluation.kappas(log(spark, y, p), label_only=True).first()
    e = (722**2 + 751**2) / 1473**2
    assert k.kappa == pytest.approx((right / 1473 - e) / (1 - e))
    assert (0.617108 - e) / (1 - e) == pytest.approx(0.233919, abs=1e-5)
    assert k.kappa_m == pytest.approx((right / 1473 - 751 / 1473) / (1 - 751 / 1473))


def test_kappa_guards(spark):
    k = evaluation.kappas(log(spark, [0, 0, 0], [0, 0, 1])).first()
    assert k.kappa_m == 0 and k.kappa_t is None


def test_horizons_are_inclusive_and_skip_the_first_drift(spark):
    n = 400
    drifts = [int(i in (100, 200, 300)) for i in range(n)]
    rows = log(spark, [0] * n, [0] * n, drift_occured=drifts)
    assert evaluation.after_drift(rows, 50).count() == 51 * 2


def test_merges_of_merges(spark):
    m = spark.createDataFrame([(0, 5, 4), (0, 4, 2), (0, 2, 1), (1, 5, 3)], "stream_id int, old int, new int")
    got = {(r.stream_id, r.old): r.model for r in evaluation.resolve_merges(m).collect()}
    assert got == {(0, 5): 1, (0, 4): 1, (0, 2): 1, (1, 5): 3}
    with pytest.raises(ValueError):
        evaluation.resolve_merges(spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "stream_id int, old int, new int"), 8)


def test_window_rules_for_constant_frames(spark):
    rows = spark.createDataFrame([(0, i, 5.0) for i in range(10)], "stream_id int, example int, x double")
    m = windows.moments(rows, "x", 4).orderBy("example").collect()[-1]
    assert (m.stdev, m.skew, m.kurtosis) == (0, 0, -3)
    a = windows.autocorrelations(rows, "x", 4).collect()[-1]
    assert (a.acf_1, a.acf_2, a.pacf_2) == (0, 0, 0)


def test_windows_equal_the_stateful_form(spark):
    from recurra.streaming.metafeatures import basic

    x = np.random.default_rng(4).normal(size=60).round(3)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "stream_id int, example int, x double")
    m = {r.example: r for r in windows.moments(rows, "x", 20).collect()}
    a = {r.example: r for r in windows.autocorrelations(rows, "x", 20).collect()}
    t = {r.example: r for r in windows.turning_point_rate(rows, "x", 20).collect()}
    for i in (5, 19, 40, 59):
        b = {k: v[0] for k, v in basic(x[max(0, i - 19) : i + 1, None]).items()}
        for k in ("mean", "stdev", "skew", "kurtosis"):
            assert m[i][k] == pytest.approx(b[k], abs=1e-9)
        for k in ("acf_1", "acf_2", "pacf_1", "pacf_2"):
            assert a[i][k] == pytest.approx(b[k], abs=1e-9)
        assert t[i].turning_point_rate == pytest.approx(b["turning_point_rate"])


def test_blocks_do_not_change_frames(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=90).round(3)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "stream_id int, example int, x double")
    forms = [lambda: windows.moments(rows, "x", 10), lambda: windows.autocorrelations(rows, "x", 10), lambda: windows.turning_point_rate(rows, "x", 10), lambda: windows.stable_mean(rows, "x", 5, 4)]
    whole = [sorted(map(tuple, f().collect())) for f in forms]
    monkeypatch.setattr(windows, "BLOCK", 16)
    for f, want in zip(forms, whole, strict=True):
        got = sorted(map(tuple, f().collect()))
        assert len(got) == 90 and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want, strict=True))
    log = rows.selectExpr("stream_id", "example", "cast(x > 0 as int) as is_correct")
    assert sorted(map(tuple, evaluation.running_accuracy(log, 7).collect())) == sorted(map(tuple, evaluation.running_accuracy(log).collect()))


def test_error_distances_of_the_fixture(spark):
    rows = log(spark, [1, 0, 1, 0], [1, 1, 0, 0])
    assert [r.error_distance for r in windows.error_distances(rows).collect()] == [1]


def test_transitions(spark):
    rows = spark.createDataFrame([(0, i, m) for i, m in enumerate([0, 0, 1, 1, 0, 2])], "stream_id int, example int, active_model int")
    n = {(r.src, r.dst): r.n for r in transitions.counts(rows).collect()}
    assert n == {(0, 0): 1, (0, 1): 1, (1, 1): 1, (1, 0): 1, (0, 2): 1}
    merged = transitions.remapped(transitions.counts(rows), spark.createDataFrame([(0, 2, 1)], "stream_id int, old int, model int"))
    assert {(r.src, r.dst): r.n for r in merged.collect()} == {(0, 0): 1, (0, 1): 2, (1, 1): 1, (1, 0): 1}


def test_pattern_and_layout(spark):
    assert compose.recurrence_pattern(3, 2, 1) == [0, 1, 2, 0, 1, 2]
    assert compose.recurrence_pattern(5, 4, 7, 0.5, 3, 0.2) == compose.recurrence_pattern(5, 4, 7, 0.5, 3, 0.2)
    rows = [tuple(r) for r in compose.segments(spark, {"a": 10, "b": 5}, ["a", "b", "a"]).collect()]
    assert rows == [(0, 0, 9, "a"), (1, 10, 14, "b"), (2, 15, 24, "a")]
    shared = [r.end - r.start + 1 for r in compose.segments(spark, {"a": 10, "b": 5}, ["a", "b", "a"], proportion=-1).collect()]
    assert shared == [5, 5, 5]


def test_short_concepts_start_over(spark):
    concept = spark.createDataFrame([("a", i, [float(i)], i) for i in range(3)], "concept string, position long, x array<double>, y int")
    places = spark.range(7).select(F.lit(0).cast("long").alias("stream_id"), F.col("id").alias("example"))
    pieces = compose.segments(spark, {"a": 7}, ["a"]).withColumn("stream_id", F.lit(0).cast("long"))
    got = compose.compose(concept, compose.locate(places, pieces)).orderBy("example")
    assert [r.y for r in got.collect()] == [0, 1, 2, 0, 1, 2, 0]
