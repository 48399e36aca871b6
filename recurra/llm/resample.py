"""Importance resampling of raw text toward a target: hashed n-gram models and Gumbel top-k.

Words and pairs of neighbouring words are hashed to buckets. A bag-of-buckets model is fitted to the target documents
and one to all raw documents; a document's log importance weight is the sum of the log ratios over its n-grams. Adding
Gumbel noise drawn from its id and taking the k largest samples k documents without replacement in proportion to the
weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, save

_TABLE = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def buckets(text: str | None, size: int, memo: dict[bytes, int]) -> np.ndarray:
    """Bucket of every word and word pair of the whole text."""
    own = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    h = np.empty(len(own), np.int64)
    for i, w in enumerate(own):
        x = memo.get(w)
        if x is None:
            x = zlib.crc32(w)
            if len(memo) < 200_000 and len(w) < 64:
                memo[w] = x
        h[i] = x
    two = (h[:-1] * 0x9E3779B1 + h[1:] * 0x85EBCA77) & 0x7FFFFFFFFFFFFFFF
    return np.concatenate([h % size, (two >> 13) % size])


def bucket_counts(rows: DataFrame, size: int) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows, and over those with in_target. rows: text, in_target."""

    def run(batches):
        memo: dict[bytes, int] = {}
        total = np.zeros((2, size), np.int64)
        for b in batches:
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets(t, size, memo), minlength=size)
                total[0] += n
                if good:
                    total[1] += n
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], names=["bucket", "raw", "target"])

    part = rows.mapInArrow(run, "bucket int, raw long, target long")
    return part.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, size: int, smooth: float = 1.0) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw) with add-`smooth` estimates; at most `size` rows are collected."""
    n = np.zeros((2, size))
    for r in counts.collect():
        n[0, r["bucket"]], n[1, r["bucket"]] = r["raw"], r["target"]
    n += smooth
    p = np.log(n / n.sum(1, keepdims=True))
    return (p[1] - p[0]).astype(np.float64)


def weigh(docs: DataFrame, target_ids: DataFrame, size: int = 10_000, seed: int = 7) -> DataFrame:
    """(doc_id, log_weight, gumbel_key) of every row.

    target_ids: doc_id of the target documents. Null or empty text has weight 0 in log. Repeated rows have equal keys; a
    row with a null doc_id takes the noise of its text. No target documents: the target model is uniform.
    """
    ids = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("t_id")).distinct()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The texts stay where they are if the counted ids, a long each, may be broadcast; beyond that they are shuffled once.
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    marked = keyed.join(ids, keyed.doc_id == ids.t_id, "left").select("text", F.col("t_id").isNotNull().alias("in_target"))
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(bucket_counts(marked, size), size))

    def run(batches):
        memo: dict[bytes, int] = {}
        ratio = shared.value
        for b in batches:
            w = [float(ratio[buckets(t, size, memo)].sum()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(w, pa.float64())], names=["doc_id", "draw", "log_weight"])

    own = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.lit("text"), "text")).otherwise(F.xxhash64(F.lit(seed), "doc_id"))
    scored = keyed.select("doc_id", "text", own.alias("draw")).mapInArrow(run, "doc_id long, draw long, log_weight double")
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    return scored.select("doc_id", "log_weight", (F.col("log_weight") - F.log(-F.log(u))).alias("gumbel_key"))


def top_by_key(rows: DataFrame, key: str, k: int, ties: list[str], narrow: int = 4096) -> DataFrame:
    """rows plus selected: true for the k rows with the largest key (ties by `ties`, then any of equal rows).

    Exact without a global sort: counts in 256 equal steps narrow the range of the k-th key until it holds few rows or
    one value; only those rows are ranked. Where more rows than that share the value, those that are equal in `ties` too
    are ranked by their place in the table, again by narrowing.
    """
    stats = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, above = stats["lo"], stats["hi"], 0
    if stats["n"] <= k or lo is None:
        return rows.withColumn("selected", F.lit(True))
    inside = stats["n"]
    while inside > narrow and hi > lo:
        step = (hi - lo) / 256
        own = rows.where(F.col(key).between(lo, hi))
        at = F.least(F.floor((F.col(key) - lo) / step), F.lit(255)).cast("int")
        per = {r["at"]: r for r in own.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for i in sorted(per, reverse=True):
            if above + per[i]["n"] >= k:
                lo, hi, inside = per[i]["lo"], per[i]["hi"], per[i]["n"]
                break
            above += per[i]["n"]
    edge = rows.where(F.col(key).between(lo, hi))
    if inside <= narrow:
        ranked = edge.withColumn("r", F.row_number().over(Window.orderBy(F.desc(key), *ties)))
        ranked = ranked.withColumn("selected", F.col("r") <= k - above).drop("r")
    elif ties:
        # One value: the smaller in the first of `ties` come first, nulls before all.
        first = F.coalesce(-F.col(ties[0]).cast("double"), F.lit(1e300))
        ranked = top_by_key(save(edge.withColumn(f"{key}_t", first), "ties"), f"{key}_t", k - above, ties[1:], narrow).drop(f"{key}_t")
    else:
        place = -F.monotonically_increasing_id().cast("double")
        ranked = top_by_key(save(edge.withColumn(f"{key}_p", place), "places"), f"{key}_p", k - above, [f"{key}_p"], narrow).drop(f"{key}_p")
    rest = rows.where((F.col(key) > hi) | (F.col(key) < lo)).withColumn("selected", F.col(key) > hi)
    return rest.unionByName(ranked)


def resample(docs: DataFrame, target_ids: DataFrame, share: float = 0.5, **options) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) of every row; `share` of the rows is selected, rounded down."""
    rows = save(weigh(docs, target_ids, **options), "weights")
    return top_by_key(rows, "gumbel_key", int(share * rows.count()), ["doc_id"])
