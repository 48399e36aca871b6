"""Streams and logs made of the relational tables, and the same in SQL for comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STREAMS, SEGMENT, CONCEPTS, MODEL_RUN, MODELS = 10, 100, 3, 130, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered() -> Window:
    return Window.partitionBy("stream_id").orderBy("example")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, example, value, k, y): events of a stream in order of time; y is the dense code of the type.

    Rows are numbered inside a stream's day and start from the number of rows of the days before, so no task sorts a
    whole stream.
    """
    e = table(spark, sf_dir, "events")
    # A code per type by order of name: a window over the few distinct types.
    codes = e.select("event_type").distinct().withColumn("y", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("int"))
    stream = F.pmod("user_id", F.lit(STREAMS))
    place = Window.partitionBy("stream_id", "day").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("double")
    day = F.to_date("ts").alias("day")
    rows = e.select(stream.alias("stream_id"), day, "ts", "event_id", "value", k.alias("k"), "event_type")
    before = Window.partitionBy("stream_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = e.groupBy(stream.alias("stream_id"), day).agg(F.count(F.lit(1)).alias("n"))
    days = days.select("stream_id", "day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = rows.join(days, ["stream_id", "day"]).withColumn("example", F.col("first") + F.row_number().over(place) - 1)
    return rows.join(codes, "event_type").select("stream_id", "example", "value", "k", "y")


def experience_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-observation log over the event streams: label, prediction, true concept, active model, changes.

    The prediction is the label where k < 60, else the label before. The concept of a segment's last row is null:
    ground truth uses an exclusive end, as the evaluation expects.
    """
    s = event_stream(spark, sf_dir)
    o = ordered()
    segment = F.floor(F.col("example") / SEGMENT)
    concept = F.when(F.col("example") % SEGMENT == SEGMENT - 1, None).otherwise((segment % CONCEPTS).cast("int"))
    model = (F.floor((F.col("example") + 37) / MODEL_RUN) % MODELS).cast("int")
    log = s.select(
        "*",
        F.when(F.col("k") < 60, F.col("y")).otherwise(F.lag("y", 1, 0).over(o)).cast("int").alias("p"),
        concept.alias("concept"),
        model.alias("active_model"),
        ((F.col("example") % SEGMENT == 0) & (F.col("example") > 0)).cast("int").alias("drift_occured"),
    )
    changed = F.coalesce(F.col("active_model") != F.lag("active_model").over(o), F.lit(False)).cast("int")
    return log.select("*", (F.col("y") == F.col("p")).cast("int").alias("is_correct"), changed.alias("change_detected"))


STREAM_SQL = f"""
codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS y FROM (SELECT DISTINCT event_type FROM events)),
stream AS (
  SELECT user_id % {STREAMS} AS stream_id, row_number() OVER (PARTITION BY user_id % {STREAMS} ORDER BY ts, event_id) - 1 AS example,
    value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(c.y AS INTEGER) AS y
  FROM events e JOIN codes c USING (event_type)
)"""

LOG_SQL = f"""{STREAM_SQL},
log0 AS (
  SELECT *, CAST(CASE WHEN k < 60 THEN y ELSE lag(y, 1, 0) OVER o END AS INTEGER) AS p,
    CAST(CASE WHEN example % {SEGMENT} <> {SEGMENT - 1} THEN (example // {SEGMENT}) % {CONCEPTS} END AS INTEGER) AS concept,
    CAST(((example + 37) // {MODEL_RUN}) % {MODELS} AS INTEGER) AS active_model,
    CAST(example % {SEGMENT} = 0 AND example > 0 AS INTEGER) AS drift_occured
  FROM stream WINDOW o AS (PARTITION BY stream_id ORDER BY example)
),
log AS (
  SELECT *, CAST(y = p AS INTEGER) AS is_correct,
    CAST(coalesce(active_model <> lag(active_model) OVER (PARTITION BY stream_id ORDER BY example), false) AS INTEGER) AS change_detected
  FROM log0
)"""


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null where b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
