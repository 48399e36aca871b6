"""Stateful parts: ADWIN, tree, meta-features, sketch, systems, and batch against streaming."""

import math

import numpy as np
import pytest

from recurra.streaming import metafeatures as meta
from recurra.streaming.adwin import Adwin
from recurra.streaming.replay import replay, streaming
from recurra.streaming.sketch import FrequentDirections
from recurra.streaming.system import AdaptiveSystem, BoundSystem, Options, make
from recurra.streaming.tree import HoeffdingTree, bound


def test_adwin_finds_changes_and_their_direction():
    rng = np.random.default_rng(1)
    a, cuts = Adwin(0.002), []
    for i, p in enumerate([0.2] * 1000 + [0.8] * 1000 + [0.1] * 1000):
        if a.add(float(rng.random() < p)):
            cuts.append((i, a.after > a.before))
    assert 1000 < cuts[0][0] < 1150 and cuts[0][1]
    assert any(2000 < i < 2150 and not up for i, up in cuts)
    assert abs(a.mean - 0.1) < 0.06 and a.width < 1100


def test_adwin_is_quiet_on_a_constant_rate():
    rng = np.random.default_rng(2)
    a = Adwin(0.002)
    assert sum(a.add(float(v)) for v in rng.random(5000) < 0.3) <= 1
    values = rng.random(300)
    b = Adwin(1e-12)
    for v in values:
        b.add(float(v))
    assert b.mean == pytest.approx(values.mean()) and b.variance == pytest.approx(values.var())


def moons(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    return x, ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(int)


def test_tree_learns_and_explains(spark):
    x, y = moons(6000)
    t, right = HoeffdingTree(2, 4), 0
    for i in range(len(x)):
        right += t.predict_one(x[i]) == y[i]
        t.fit_one(x[i], y[i])
    assert right / len(x) > 0.7 and t.evolution >= 1
    assert (t.predict(x[:200]) == [t.predict_one(v) for v in x[:200]]).all()
    phi = np.abs(t.attributions(x[:500])).sum(0)
    assert phi[:2].sum() > phi[2:].sum()
    df = spark.createDataFrame([(v.tolist(),) for v in x[:50]], "x array<double>")
    from pyspark.sql import functions as F

    by_sql = [r.p for r in df.select(F.expr(t.sql()).alias("p")).collect()]
    votes = []
    for v in x[:50]:
        leaf = t._find(v)[0]
        votes.append(int(leaf.counts.argmax()))
    assert by_sql == votes
    assert bound(1.0, 1e-7, 200) == pytest.approx(math.sqrt(math.log(1e7) / 400))


def test_attributions_add_up():
    x, y = moons(5000, 3)
    t = HoeffdingTree(2, 4)
    for i in range(len(x)):
        t.fit_one(x[i], y[i])
    for v in x[:20]:
        leaf = t._find(v)[0]
        assert t.attributions(v[None]).sum() == pytest.approx(leaf.counts[0] - t.root.counts[0])


def test_lower_bound_is_a_plain_tree():
    x, y = moons(1500, 5)
    b, t = BoundSystem(4, Options(fit_weight=1)), HoeffdingTree(2, 4)
    for v, c in zip(x, y, strict=True):
        b.at("c")
        assert b.predict(v) == t.predict_one(v)
        b.learn(v, int(c))
        t.fit_one(v, int(c))


def test_metafeatures():
    x = np.array([1.0, 3, 2, 5, 4, 4])
    b = {k: v[0] for k, v in meta.basic(x[:, None]).items()}
    assert b["turning_point_rate"] == pytest.approx(3 / 6)
    d = x - x.mean()
    assert b["acf_1"] == pytest.approx((d[1:] * d[:-1]).sum() / (d * d).sum())
    assert meta.basic(np.ones((5, 1)))["kurtosis"][0] == -3
    assert meta.permutation_entropy(np.arange(10.0)) == 0
    assert meta.permutation_entropy(np.random.default_rng(1).random(4000)) == pytest.approx(math.log2(6), abs=0.02)
    rng = np.random.default_rng(2)
    a = rng.normal(size=800)
    rho = 0.9
    got = meta.knn_mi(a, rho * a + math.sqrt(1 - rho**2) * rng.normal(size=800))
    assert got == pytest.approx(-0.5 * math.log(1 - rho**2), abs=0.12)
    assert meta.knn_mi(a, rng.normal(size=800)) < 0.1
    t = np.linspace(0, 1, 400)
    parts = meta.emd(np.sin(80 * math.pi * t) + 3 * t)
    assert np.allclose(sum(parts), np.sin(80 * math.pi * t) + 3 * t) and len(parts) >= 2
    assert list(meta.error_gaps(np.array([1, 0, 0, 1]))) == [1.0]


def test_sketch_bound_and_merge():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 20)) + 0.01 * rng.normal(size=(400, 20))
    a, b = FrequentDirections(20, 8), FrequentDirections(20, 8)
    for i, r in enumerate(m):
        (a if i % 2 else b).append(r)
    s = a.merge(b).rows()
    assert len(s) <= 8
    assert np.linalg.norm(m.T @ m - s.T @ s, 2) <= 2 * (m**2).sum() / 8


def test_sketch_keeps_as_many_directions_as_asked():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    s = FrequentDirections(12, 4)
    for i in range(400):
        s.append(q[i % 4] * (4 - i % 4))
    held = s.rows()
    assert len(held) == 4 and np.allclose(held.T @ held, sum(100 * (4 - i) ** 2 * np.outer(q[i], q[i]) for i in range(4)))
    assert np.allclose((s.observations() ** 2).sum() / 4, sum((4 - i) ** 2 for i in range(4)) / 4)
    lo, hi = s.column_range(3)
    assert lo <= hi and s.column_histogram(3, 5).sum() == 4
    assert s.similarity(q[2] * 7, q[9]) < 1e-9 < 0.99 < s.similarity(q[10], q[9])


def stagger(n, repeats=2, seed=1):
    rng = np.random.default_rng(seed)
    xs, ys, cs = [], [], []
    for _ in range(repeats):
        for c in range(3):
            x = rng.integers(0, 3, (n, 3)).astype(float)
            ys.append([(x[:, 0] == 0) & (x[:, 1] == 0), (x[:, 1] == 1) | (x[:, 2] == 0), (x[:, 0] == 1) | (x[:, 0] == 2)][c].astype(int))
            xs.append(x)
            cs += [c] * n
    return np.vstack(xs), np.concatenate(ys), cs


@pytest.mark.parametrize(("name", "rows", "least"), [("CC", 1000, 0.93), ("fingerprint", 2000, 0.9), ("upper_bound", 1000, 0.97), ("arf", 500, 0.9)])
def test_systems_follow_recurring_concepts(name, rows, least):
    x, y, c = stagger(rows)
    s, right, models = make(name, 3, Options()), 0, set()
    for v, k, known in zip(x, y, c, strict=True):
        if hasattr(s, "at"):
            s.at(known)
        right += s.predict(v) == k
        models.add(s.learn(v, int(k))["active_model"])
    assert right / len(y) > least
    if name == "CC":
        assert len(models) >= 3


def test_state_is_bounded():
    x, y, _ = stagger(1500, 1)
    s = AdaptiveSystem(3, Options(recent_cap=300))
    for v, k in zip(x, y, strict=True):
        s.learn(v, int(k))
    assert all(len(z.window) <= 300 and len(z.window.y) == 600 for z in s.states.values())
    assert all(len(z.cached) <= 5 and len(z.record) <= 49 for z in s.states.values())


def test_unknown_names():
    with pytest.raises(ValueError):
        make("nothing", 2, Options())


def test_streaming_equals_batch(spark, tmp_path):
    rows = []
    for s in range(2):
        x, y, c = stagger(150, 1, s)
        rows += [(s, i, v.tolist(), int(k), str(z)) for i, (v, k, z) in enumerate(zip(x, y, c, strict=True))]
    rows[5] = (0, 5, rows[5][2], None, "0")
    rows[6] = (0, 6, None, 1, "0")
    schema = "stream_id long, example long, x array<double>, y int, concept string"
    df = spark.createDataFrame(rows, schema)
    batch = {(r.stream_id, r.example): r for r in replay(df).collect()}
    assert len(batch) == len(rows) - 1 and batch[0, 5].y is None
    src = str(tmp_path / "in")
    for i in range(3):
        df.where(f"floor(example / 150) = {i}").coalesce(1).write.mode("append").parquet(src)
    live = streaming(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = live.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.stream_id, r.example): r for r in spark.table("live").collect()}
    assert got == batch


def test_event_time_windows(spark, tmp_path):
    from recurra.streaming.events import once, sessions, windowed_accuracy

    df = spark.sql("select 0 as stream_id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id*10) as ts, cast(id % 2 as int) as is_correct from range(12)")
    assert sum(r.rows for r in windowed_accuracy(df).collect()) == 12
    assert sessions(df, "15 minutes").count() == 1
    assert callable(once)


def test_unknown_names_are_refused():
    for bad in ({"weighting": "Cachehistogram_MI"}, {"similarity": "sketch"}):
        with pytest.raises(ValueError):
            Options(**bad)


def fed(n=900, **options):
    xs, ys, _ = stagger(n // 3, 1)
    s = AdaptiveSystem(xs.shape[1], Options(**options))
    for x, y in zip(xs, ys):
        s.learn(x, int(y))
    return s


def test_recorded_distances_follow_the_weights_of_now():
    s = fed()
    own = next(st for st in s.states.values() if len(st.record) > 5)
    mean, _ = s._usual(own)
    again = [s._distance(own, v, only) / old for old, v, only in list(own.samples)[::5] if old]
    assert len(own.samples) == len(own.record) and mean == pytest.approx(np.mean(own.record) * np.mean(again))
    s.o.adjust_similarity = False
    own.adjusted = (-1, 1.0)
    assert s._usual(own)[0] == pytest.approx(np.mean(own.record))


def test_a_warning_comes_with_less_evidence_than_a_drift():
    rng = np.random.default_rng(4)
    s = AdaptiveSystem(3, Options())
    drift = None
    for i in range(2000):
        s.example = i
        if s._watch(float(np.clip(rng.normal(0.8 if i < 1000 else 0.55, 0.2), 0, 1))) and i > 1000:
            drift = i
            break
    assert drift and 1000 < s.last_warning <= drift


def test_performance_signals_start_over_when_the_window_is_of_the_new_model():
    s = fed()
    own = s.states[s.active]
    before = own.print.copy()
    kept = len(own.cached)
    s._evolved(own)
    assert own.dirty == s.o.window_size and own.since_reset == 0 and len(own.cached) == min(kept + 1, s.o.fingerprint_cache)
    s._take_print(own)
    assert (own.print.seen[s.bound] == 1).all() and (own.print.seen[~s.bound] == before.seen[~s.bound] + 1).all() and own.since_reset == 1
    own.dirty = 1
    s._observe(own, own.window.x[own.window.end - 1], 0)
    assert own.dirty in (0, s.o.window_size) and (own.dirty or own.since_reset == 0)


def test_missing_labels_are_imputed_where_asked():
    import pandas as pd

    from recurra.streaming.replay import step

    xs, ys, _ = stagger(60, 1)
    rows = pd.DataFrame({"example": range(len(xs)), "x": list(xs), "y": [None if i % 4 == 3 else float(y) for i, y in enumerate(ys)]})
    seen = {}
    for impute in (False, True):
        system = AdaptiveSystem(3, Options(impute_labels=impute))
        log = step(system, 0, rows)
        seen[impute] = system.example
        assert [r[4] is None for r in log] == [i % 4 == 3 for i in range(len(xs))]
    assert seen[True] == len(xs) and seen[False] == len(xs) * 3 // 4


def wandering(n=4000):
    """A stream in which many states arise: each value stays for some rows and decides the label."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.random((n // 40, 2)) * 100, 40, axis=0)
    return x, ((x[:, 0] < 50) ^ (rng.random(n) < x[:, 1] / 200)).astype(int)


@pytest.mark.parametrize("quiet", [True, False])
def test_inactive_states_are_weighed_together(monkeypatch, quiet):
    x, y = wandering()
    # Forced drifts start states; quiet detectors let them stay, the others bring deletions and a merge.
    detectors = {"sensitivity": 1e-9, "estimator_risk": 1e-9, "swap_risk": 1e-9} if quiet else {"merge_threshold": 0.3}
    options = Options(min_drift_likelihood=2.0, forced_drifts=frozenset(range(400, 4000, 400)), bypass_grace_threshold=0.0, fingerprint_grace_period=2, state_grace_windows=2, **detectors)
    logs, calls = [], []
    plain = AdaptiveSystem._describe
    monkeypatch.setattr(AdaptiveSystem, "_describe", lambda self, s, *a: calls.append(s.id not in (-1, self.active)) or plain(self, s, *a))
    for batched in (True, False):
        s, log = AdaptiveSystem(2, options), []
        s.batched = s.batched and batched
        calls.clear()
        for v, k in zip(x, y, strict=True):
            log.append({"p": s.predict(v), **s.learn(v, int(k))})
        logs.append(log)
        assert any(calls) != batched  # no inactive state is described by itself
        assert len(s.states) > 5 if quiet else any(r["merges"] for r in log) and any(r["deletions"] for r in log)
    assert logs[0] == logs[1]


def test_bank_equals_single_detectors():
    from recurra.streaming.bank import AdwinBank, gap_statistics

    rng = np.random.default_rng(12)
    bank, single = AdwinBank(5, 0.5), [Adwin(0.5, clock=1) for _ in range(5)]
    for i in range(600):
        v = np.clip(rng.normal(0.5 + 0.3 * np.sin(i / 90 + np.arange(5)), 0.1), 0, 1)
        bank.add(v)
        for a, z in zip(single, v.tolist(), strict=True):
            a.add(z)
        assert [a.width for a in single] == bank.width.tolist() and [a.mean for a in single] == bank.mean.tolist()
    assert [a.variance for a in single] == [bank.variance(i) for i in range(5)]
    right = (rng.random((60, 100)) < np.linspace(0, 1, 60)[:, None]).astype(float)
    got = gap_statistics(right)
    for i, r in enumerate(right):
        assert {k: v[0] for k, v in meta.basic(meta.error_gaps(r)[:, None]).items()} == {k: v[i] for k, v in got.items()}


def test_each_stream_has_a_task_of_its_own_and_is_logged_in_pieces(spark):
    from pyspark.sql import functions as F

    rows = spark.range(12 * 30).select((F.col("id") % 12 * 32).alias("stream_id"), F.floor(F.col("id") / 12).alias("example"), F.array(F.col("id") % 7.0).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    log = replay(rows, "lower_bound").withColumn("part", F.spark_partition_id())
    got = log.groupBy("part").agg(F.countDistinct("stream_id").alias("streams"), F.count("*").alias("n")).collect()
    assert len(got) == 12 and all(r.streams == 1 and r.n == 30 for r in got)
