"""Files of runs: logs, options and results; reading tolerates bad files, writing is idempotent by option hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a per-observation log, in order.
LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("example",)]
    + [T.StructField(c, T.IntegerType()) for c in ("y", "p", "is_correct")]
    + [T.StructField(c, T.LongType()) for c in ("right_sum", "wrong_sum")]
    + [T.StructField("overall_accuracy", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("active_model", "ground_truth_concept", "drift_occured", "change_detected", "model_evolution")]
    + [
        T.StructField(c, T.StringType())
        for c in (
            "active_state_active_similarity", "active_state_buffered_similarity", "all_state_buffered_similarity", "all_state_active_similarity",
            "feature_weights", "concept_likelihoods", "concept_priors", "concept_priors_1h", "concept_priors_2h", "concept_posteriors",
            "adwin_likelihood_estimate", "adwin_posterior_estimate", "adwin_likelihood_estimate_background", "adwin_posterior_estimate_background",
            "merges", "deletions",
        )
    ]
    + [T.StructField(c, T.DoubleType()) for c in ("cpu_time", "ram_use", "fingerprint_ram")]
)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Per-run CSV logs with the file's name as run; malformed rows are left out."""
    return spark.read.schema(LOG_SCHEMA).option("header", True).option("mode", "DROPMALFORMED").csv(path).withColumn("run", F.col("_metadata.file_name"))


def read_results(spark: SparkSession, path: str, pattern: str = "results_run_*.txt") -> DataFrame:
    """Result files, one JSON object each, found in all subfolders; files that do not parse are left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(path)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True)
    schema = files.option("mode", "DROPMALFORMED").json(path).schema
    parsed = raw.select(F.col("_metadata.file_name").alias("file"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null").select("file", "r.*")


def same_options(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a with the row of b that agrees on all keys, null with null: the golden run of a run. b's columns are b_*."""
    other = b.select(*[F.col(f"`{c}`").alias(f"b_{c}") for c in b.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return a.join(other, on)


def read_options(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object per row."""
    results.write.mode("append").json(path)


def pending(requested: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Requested options without a result under `path` that agrees on the keys."""
    spark = requested.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return requested
    return requested.join(spark.read.json(path).select(*keys).distinct(), keys, "left_anti")


def write_arff(stream: DataFrame, name: str, path: str, features: int) -> None:
    """A stream as ARFF text: numeric attributes, then the sorted class domain; rows in order of example.

    One file by nature of the format, so one task writes it; the rows are sorted by all tasks before. The class domain is
    a parameter of the format and as small as it.
    """
    spark = stream.sparkSession
    domain = ",".join(str(r["y"]) for r in stream.select("y").distinct().orderBy("y").collect())
    head = [f"@RELATION {name}", *[f"@ATTRIBUTE attrib{i} NUMERIC" for i in range(features)], f"@ATTRIBUTE class {{{domain}}}", "@DATA"]
    line = F.concat_ws(",", F.array_join(F.col("x").cast("array<string>"), ","), F.col("y").cast("string"))
    lines = stream.select(F.col("example").cast("long").alias("at"), line.alias("value"))
    top = spark.createDataFrame([(-len(head) + i, h) for i, h in enumerate(head)], "at long, value string")
    top.unionByName(lines).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(path)


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Missing columns are added, nulls filled."""
    for c, v in defaults.items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v))
    return rows


#: Columns of other engines' result files and the log columns they stand for, first match wins.
EXTERNAL = {
    "example": ("example", "learning evaluation instances", "instances"),
    "overall_accuracy": ("overall_accuracy", "classifications correct (percent)", "accuracy"),
    "active_model": ("active_model", "system_concept", "model"),
    "ram_use": ("ram_use", "model serialized size (bytes)", "memory"),
    "cpu_time": ("cpu_time", "evaluation time (cpu seconds)", "time"),
}


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Result CSVs of other engines under the log's column names; missing columns are null, percents become shares."""
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    known = {c.strip().lower(): c for c in raw.columns}
    out = []
    for name, aliases in EXTERNAL.items():
        found = next((known[a] for a in aliases if a in known), None)
        c = F.col(f"`{found}`").cast("double") if found else F.lit(None).cast("double")
        if found and "percent" in found:
            c = c / 100
        out.append(c.alias(name))
    return raw.select(*out)


def cached(make, path: str, spark: SparkSession) -> DataFrame:
    """The table stored at `path`; where there is none, what `make` returns is stored first."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_options(spark: SparkSession, options: dict, path: str) -> None:
    """A run's or generator's parameters as one JSON object; the writer's _SUCCESS mark tells that it is complete."""
    import json

    spark.createDataFrame([(json.dumps(options, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)
