"""Files, generators and the data source."""

import json
import math

import pytest
from pyspark.sql import functions as F

from recurra.plans import experiments
from recurra.sources import concepts, datasets, datasource, generators, logs


def write(path, rows):
    path.write_text("\n".join(",".join(map(str, r)) for r in rows) + "\n")


def test_concept_files(spark, tmp_path):
    write(tmp_path / "d_1.csv", [("", "a", "b", "label"), (0, 1, "x", 2), (1, 2, "y", 1), (2, 3, "x", 2)])
    write(tmp_path / "d_2.csv", [("", "a", "b", "label"), (0, 5, "y", 1), (1, 6, "y", 2)])
    rows = concepts.read_concepts(spark, str(tmp_path)).orderBy("concept", "position").collect()
    assert [(r.concept, r.position, r.x, r.y) for r in rows] == [
        ("d_1", 0, [1.0, 0.0], 1), ("d_1", 1, [2.0, 1.0], 0), ("d_1", 2, [3.0, 0.0], 1), ("d_2", 0, [5.0, 1.0], 0), ("d_2", 1, [6.0, 1.0], 1),
    ]
    own = concepts.read_concepts(spark, str(tmp_path), label_coding="per_concept").orderBy("concept", "position").collect()
    assert [r.y for r in own] == [0, 1, 0, 0, 1]
    assert concepts.read_concepts(spark, str(tmp_path), nrows=1).count() == 2
    with pytest.raises(ValueError):
        concepts.read_concepts(spark, str(tmp_path), label_coding="other")


def test_generators_are_reproducible_and_balanced(spark):
    for name in ("STAGGERS", "SEA", "ARGWAL", "RTREE", "HPLANE", "RBF", "RTREESAMPLE", "HPLANESAMPLE", "WINDSIM"):
        a = generators.concepts(spark, name, 1, 150)
        n = generators.CATALOGUE[name][1]
        assert a.count() == 150 * n
        assert a.where("concept like '%_0'").select("concept").distinct().count() == 1
        first = sorted(map(str, a.where("position < 5").collect()))
        assert first == sorted(map(str, generators.concepts(spark, name, 1, 150).repartition(3).where("position < 5").collect()))
        assert first != sorted(map(str, generators.concepts(spark, name, 2, 150).where("position < 5").collect()))
        assert a.where("y is null or y < 0").count() == 0
    with pytest.raises(ValueError):
        generators.concepts(spark, "nothing", 1, 10)


def test_every_named_data_set_gives_rows(spark):
    assert len(generators.CATALOGUE) == 36
    for name in ("STAGGER", "SEA", "ARGWAL", "HPLANESAMPLE", "RBFEasy", "RTREEEasy", "RTREEMedSAMPLE", "RTREESAMPLE_Diff", "SynEasyA", "SynEasyF", "RTREESAMPLE-DB"):
        make, n = generators.CATALOGUE[name]
        rows = make(spark, 30, n - 1, 5 + n - 1, 1).collect()
        assert len(rows) == 30 and all(r.y >= 0 and all(v == v for v in r.x) for r in rows), name
    assert {n for n, (_, k) in generators.CATALOGUE.items() if k != 10} == {"STAGGERS", "WINDSIM"}


def test_sampler_traits(spark):
    base = generators._rows(spark, 4000)
    plain = base.select(generators.sampler(3, "a", 0.0).alias("v")).agg(F.avg("v"), F.min("v"), F.max("v")).first()
    assert abs(plain[0] - 0.5) < 0.03 and plain[1] >= 0 and plain[2] <= 1
    values = {}
    for traits in (("distribution",), ("autocorrelation",), ("frequency",), generators.TRAITS):
        v = [r.v for r in base.select("example", generators.sampler(3, "a", 1.0, traits).alias("v")).orderBy("example").collect()]
        values[traits] = sum((a - sum(v) / 4000) * (b - sum(v) / 4000) for a, b in zip(v, v[1:])) / sum((a - sum(v) / 4000) ** 2 for a in v)
        assert all(0 < x < 1 for x in v)
    assert abs(values[("distribution",)]) < 0.1 < min(values[("autocorrelation",)], values[("frequency",)])


def test_sinh_arcsinh_density(spark):
    grid = spark.range(-8000, 8001).select((F.col("id") / 100).alias("x"))
    for skew, tail in ((0.0, 1.0), (0.7, 0.8), (-0.4, 1.6)):
        total = grid.agg(F.sum(generators.sinh_arcsinh_density(F.col("x"), skew, tail)) * 0.01).first()[0]
        assert abs(total - 1) < 2e-3
    top = spark.range(1).select(generators.sinh_arcsinh_density(F.lit(0.5), 0.0, 1.0)).first()[0]
    assert abs(top - math.exp(-0.125) / math.sqrt(2 * math.pi)) < 1e-12


def test_families_of_data_sets():
    assert datasets.expand(["STAGGER", "cmc", "STAGGER"]) == [("STAGGER", "Synthetic"), ("cmc", "Real")]
    everything = datasets.expand(["all_exp", "real"])
    assert ("RBFMed", "Synthetic") in everything and len(everything) == len(set(everything)) == len(datasets.REAL) + 5
    with pytest.raises(ValueError):
        datasets.expand(["nothing"])


def test_stream_from_options(spark):
    o = datasets.read_stream_options('{"name": "STAGGERS", "rows": 60, "repeats": 2, "drift_width": 10, "label_noise": 0.1, "classifier": "CC"}')
    s = datasets.stream(spark, o)
    rows = s.rows.orderBy("example").collect()
    assert len(rows) == s.length == s.left() == 360 and [r.example for r in rows] == list(range(360))
    assert [rows[i].concept for i in (0, 60, 120, 180)] == ["STAGGERS_0", "STAGGERS_1", "STAGGERS_2", "STAGGERS_0"]
    assert s.next(100).count() == 100 and s.next(300).count() == 260 and not s.has_more() and s.left() == 0
    s.restart()
    assert s.has_more() and s.next(5).count() == 5


def test_golden_options_and_tables(spark):
    a = spark.createDataFrame([("CC", None, 0.5), ("CD", 1, 0.7)], "classifier string, seed int, kappa double")
    b = spark.createDataFrame([("CC", None, 0.4), ("CD", 2, 0.6)], "classifier string, seed int, kappa double")
    assert [(r.classifier, r.b_kappa) for r in logs.same_options(a, b, ["classifier", "seed"]).collect()] == [("CC", 0.4)]
    cells = spark.createDataFrame([("cmc", "CC", "0.5(0.1)"), ("qg", "CC", "0.6(0.1)"), ("cmc", "ARF_1", "0.4(0.2)")], "data string, classifier string, cell string")
    table = experiments.summary_table(cells, "data", "classifier", "cell", ["CC", "ARF_1"])
    assert [tuple(r) for r in table.collect()] == [("cmc", "0.5(0.1)", "0.4(0.2)"), ("qg", "0.6(0.1)", "")]
    turned = experiments.transposed(table, "data", ["CC", "ARF_1"], ["cmc", "qg"]).orderBy("name")
    assert [tuple(r) for r in turned.collect()] == [("ARF_1", "0.4(0.2)", ""), ("CC", "0.5(0.1)", "0.6(0.1)")]
    tex = experiments.latex_table(table, "50 % of runs", bold=["CC"])
    assert r"\textbf{0.5(0.1)}" in tex and r"ARF\_1" in tex and r"50 \% of runs" in tex and tex.count(r"\\") == 3


def test_random_tree_is_balanced(spark):
    share = generators.random_tree(spark, 2000, 5, strength=0.0).agg(F.avg("y")).first()[0]
    assert 0.2 < share < 0.8


def test_data_source(spark):
    datasource.register(spark)
    df = spark.read.format("concepts").option("name", "SEA").option("rows", "20").load()
    assert df.count() == 80 and df.select("concept").distinct().count() == 4


def test_results_and_pending_runs(spark, tmp_path):
    (tmp_path / "r" / "deep").mkdir(parents=True)
    (tmp_path / "r" / "results_run_1.txt").write_text(json.dumps({"classifier": "CC", "kappa": 0.5}))
    (tmp_path / "r" / "deep" / "results_run_2.txt").write_text(json.dumps({"classifier": "CD", "kappa": 0.25}))
    assert sorted(r.kappa for r in logs.read_results(spark, str(tmp_path / "r")).collect()) == [0.25, 0.5]
    done = str(tmp_path / "done")
    asked = spark.createDataFrame([("CC", 1), ("CC", 2)], "classifier string, seed long")
    assert logs.pending(asked, done, ["classifier", "seed"]).count() == 2
    logs.write_results(asked.limit(1), done)
    assert logs.pending(asked, done, ["classifier", "seed"]).count() == 1


def test_log_round_trip_and_arff(spark, tmp_path):
    row = spark.createDataFrame([(1, 0, 0, 1)], "example long, y int, p int, is_correct int")
    full = row.select(*[F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in logs.LOG_SCHEMA])
    full.write.option("header", True).csv(str(tmp_path / "log"))
    back = logs.read_logs(spark, str(tmp_path / "log")).first()
    assert len(logs.LOG_SCHEMA) == 31 and (back.example, back.is_correct) == (1, 1)
    s = spark.createDataFrame([(1, [1.0, 2.0], 1), (0, [0.5, 1.0], 0)], "example long, x array<double>, y int")
    logs.write_arff(s, "t", str(tmp_path / "a"), 2)
    assert [r.value for r in spark.read.text(str(tmp_path / "a")).collect()] == [
        "@RELATION t", "@ATTRIBUTE attrib0 NUMERIC", "@ATTRIBUTE attrib1 NUMERIC", "@ATTRIBUTE class {0,1}", "@DATA", "0.5,1.0,0", "1.0,2.0,1",
    ]
    assert logs.with_defaults(row, {"noise": 0}).first().noise == 0


def test_external_results_cache_and_options(spark, tmp_path):
    write(tmp_path / "x.csv", [("instances", "classifications correct (percent)"), (10, 75.0)])
    r = logs.read_external(spark, str(tmp_path / "x.csv")).first()
    assert (r.example, r.overall_accuracy, r.ram_use) == (10.0, 0.75, None)
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert logs.cached(make, path, spark).count() == logs.cached(make, path, spark).count() == 3 and len(calls) == 1
    logs.write_options(spark, {"seed": 1}, str(tmp_path / "o"))
    assert logs.read_options(spark, str(tmp_path / "o")).first().seed == 1
