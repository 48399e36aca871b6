"""Concept files: one CSV per true concept, the label in the last column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_concepts(spark: SparkSession, path: str, nrows: int = 0, drop_first: bool = True, label_coding: str = "global") -> DataFrame:
    """(concept, position, x array<double>, y int) of every `*.csv` under a folder, or of one file.

    The file's stem is the concept. nrows > 0 keeps a file's first rows. drop_first removes a leading row index.
    label_coding: `global` codes labels by value over all files; `per_concept` by first appearance in each file, which
    gives one class different codes in different concepts (needed to repeat some published figures).
    """
    if label_coding not in ("global", "per_concept"):
        raise ValueError("label_coding must be global or per_concept")
    raw = spark.read.option("header", True).option("inferSchema", True).csv(path)
    columns = raw.columns[1:] if drop_first else raw.columns
    # A file may be read in several splits: its rows are in order of split and then of row id.
    named = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?$", 1).alias("concept"),
        F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), *columns,
    )
    place = Window.partitionBy("concept").orderBy("at", "id")
    rows = named.withColumn("position", F.row_number().over(place).cast("long") - 1).drop("at", "id")
    if nrows > 0:
        rows = rows.where(F.col("position") < nrows)
    *features, label = columns
    for c, kind in rows.dtypes:
        if c in features and kind == "string":
            rows = _coded(rows, c, "global")
    rows = _coded(rows, label, label_coding)
    return rows.select("concept", "position", F.array(*[F.col(f"`{c}`").cast("double") for c in features]).alias("x"), F.col(f"`{label}`").cast("int").alias("y"))


def _coded(rows: DataFrame, c: str, how: str) -> DataFrame:
    """Codes from 0: by value over all rows, or by first appearance in each concept."""
    if how == "global":
        codes = rows.select(F.col(f"`{c}`").alias("v")).distinct().withColumn("code", F.row_number().over(Window.orderBy("v")) - 1)
        return rows.join(F.broadcast(codes) if codes.count() <= 100_000 else codes, rows[f"`{c}`"].eqNullSafe(codes["v"])).withColumn(c, F.col("code")).drop("v", "code")
    first = rows.groupBy(F.col("concept").alias("k"), F.col(f"`{c}`").alias("v")).agg(F.min("position").alias("p"))
    codes = first.withColumn("code", F.row_number().over(Window.partitionBy("k").orderBy("p")) - 1)
    return rows.join(codes, (rows["concept"] == codes["k"]) & rows[f"`{c}`"].eqNullSafe(codes["v"])).withColumn(c, F.col("code")).drop("k", "v", "p", "code")


def split_concepts(rows: DataFrame, concept: str, path: str) -> None:
    """Write a table as one CSV folder per value of a concept column, without that column."""
    rows.repartition(F.col(concept)).write.mode("overwrite").partitionBy(concept).option("header", True).csv(path)
