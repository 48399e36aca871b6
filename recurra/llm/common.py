"""Shared helpers of the training-data operators: table access and written intermediates."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters of the contracts: everything but ASCII space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); one of this machine only where none is set and all
    executors are threads of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go with `release`, or when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recurra-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)
    files, where = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._recurra_path = path
    return out


def release(*saved: DataFrame) -> None:
    """Delete the files of saved tables that nothing reads any more: all that came of them has been saved itself."""
    for df in saved:
        files, where = _path(df.sparkSession, df._recurra_path)
        files.delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished query when the driver's JVM collects what refers to them; long loops
    ask for that after each round, so that their disk does not add up."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a narrow table that may be broadcast at once; beyond, both sides are shuffled. The driver holds some 250 bytes
#: of each while it builds the table, and several tables at a time.
BROADCAST_ROWS = 300_000


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join of two tables that grow with the input: sorted and shuffled whatever Spark's estimate says.

    The estimate takes an exploded row for one row and goes by compressed files, so that tables of a hundred times
    spark.sql.autoBroadcastJoinThreshold were built in the driver's memory.
    """
    return df.hint("merge")


def counted(df: DataFrame) -> DataFrame:
    """`df`, a saved narrow table, for a join: broadcast only if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else shuffled(df)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in pieces: what Python makes of its texts is held for some rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def by_ids(rows: DataFrame, ids: DataFrame, how: str, on: str | list[str] = "doc_id") -> DataFrame:
    """Join of wide rows with a narrow table of ids, broadcast only after counting it: left_semi, left_anti or inner.

    The narrow table's further columns join the rows in an inner join; ids are made distinct for the other two.
    """
    keys = [on] if isinstance(on, str) else on
    small = ids if how == "inner" else ids.select(*keys).distinct()
    out = rows.join(F.broadcast(small) if ids.count() <= BROADCAST_ROWS else shuffled(small), keys, how)
    return out.select(*rows.columns, *[c for c in small.columns if how == "inner" and c not in keys])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table: (node, root) for every node of an edge.

    Each round maps a node to the least node of its closed neighbourhood and contracts the edges; every
    edge maps to an edge, so no link is lost. Node ids should be hash-like, then rounds are logarithmic.
    Neighbour minima are combined before the shuffle, so a hub is not gathered in one task.
    """
    given = save(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null"), "edges")
    edges = given
    mapping = save(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "nodes")
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = save(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        old, near = mapping, counted(least)
        mapping = save(
            mapping.join(near, mapping.root == near.u, "left").select("node", F.coalesce("m", "root").alias("root")),
            "nodes",
        )
        release(old)
        first = edges.join(near.select(F.col("u").alias("a"), F.col("m").alias("ma")), "a")
        edges = save(
            first.join(near.select(F.col("u").alias("b"), F.col("m").alias("mb")), "b")
            .where("ma <> mb")
            .select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b"))
            .distinct(),
            "edges",
        )
        release(least)
    return mapping
