"""SimHash near-duplicates by segment popcounts: a grid range join under Manhattan distance, then exact checks.

The popcounts of a fingerprint's sixteen 4-bit segments form a vector; the Manhattan distance of two vectors
never exceeds the Hamming distance of the fingerprints. Each fingerprint enters the grid cells at distance 0
and 1 of its vector, so two fingerprints at 2 or fewer bits share a cell; pairs that share one are verified by
their exact Hamming distance. Cells with more than `cell_cap` members emit no pairs: their members are linked
through the bit-level midpoints of the Hamming ball, which is exact and linear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, counted, save, shuffled, slices

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_PIECE = 1 << 20


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text in bounded pieces."""
    low, at = text.translate(_LOWER), 0
    while at < len(low):
        cut = _SPACE.search(low, at + _PIECE)
        end = cut.start() if cut else len(low)
        yield low[at:end].split()
        at = end


def shingle_hashes(text: bytes | None, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of each run of `size` words, repeats included, in pieces; fewer words: the whole sequence."""
    kept: list[bytes] = []
    any_full = False
    for words in _pieces(text or b""):
        words = kept + words
        if len(words) >= size:
            any_full = True
            joined = b" ".join(words)
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            starts = ends - lens
            h = xxhash.xxh64_intdigest
            pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
            yield np.array([h(joined[a:b], seed) for a, b in pairs], dtype=np.uint64)
            kept = words[len(words) - size + 1 :]
        else:
            kept = words
    if not any_full and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), seed)], dtype=np.uint64)


def _majority(counts: np.ndarray, total: int) -> int:
    bits = (counts * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def simhash(text: bytes | None, size: int) -> int:
    """Signed 64-bit SimHash; zero without words."""
    counts, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, size):
        counts += _bit_counts(h)
        total += len(h)
    return _majority(counts, total) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; null text counts as empty."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            fp = [simhash(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The popcounts of the sixteen 4-bit segments, one per hex digit of a long."""
    m1, m2 = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(m1), F.shiftrightunsigned(fp, 1).bitwiseAND(m1)
    pairs = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    return pairs.bitwiseAND(m2) + F.shiftrightunsigned(pairs, 2).bitwiseAND(m2)


def _cells(fps: DataFrame, max_bits: int) -> DataFrame:
    p = F.col("p")
    around = [p]
    for i in range(16 if max_bits else 0):
        digit = F.shiftrightunsigned(p, 4 * i).bitwiseAND(F.lit(15))
        around += [F.when(digit < 4, p + F.lit(1 << 4 * i)), F.when(digit > 0, p - F.lit(1 << 4 * i))]
    return fps.select("fp", popcounts(F.col("fp")).alias("p")).select("fp", F.explode(F.array_compact(F.array(*around))).alias("cell"))


def links(fps: DataFrame, max_bits: int = 2, cell_cap: int = 64) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprint pairs at `max_bits` (0 to 2) or fewer bits.

    fps: distinct fingerprints in column fp. Sparse cells give every such pair, crowded ones a spanning set.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    cells = _cells(fps, max_bits)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = save(cells.join(shuffled(shared), "cell"), "cells")

    sparse = members.where(F.col("n") <= cell_cap)
    x = F.col("a").bitwiseXOR(F.col("b"))
    lowest = F.when(x == F.lit(-(1 << 63)), x).otherwise(x.bitwiseAND(-x))
    meet = popcounts(F.when(F.bit_count(x) == 2, F.col("a").bitwiseXOR(lowest)).otherwise(F.col("a")))
    pairs = (
        sparse.select("cell", F.col("fp").alias("a"))
        .join(shuffled(sparse.select("cell", F.col("fp").alias("b"))), "cell")
        .where((F.col("a") < F.col("b")) & (F.bit_count(x) <= max_bits) & (meet == F.col("cell")))
        .select("a", "b")
    )

    crowded = members.where(F.col("n") > cell_cap).select("fp").distinct()
    reach = [F.col("fp")] + ([F.col("fp").bitwiseXOR(F.lit((1 << i) if i < 63 else -(1 << 63))) for i in range(64)] if max_bits else [])
    ball = crowded.select("fp", F.explode(F.array(*reach)).alias("mid"))
    if max_bits == 1:
        # Two neighbours at one bit: one of them is the midpoint itself.
        hub = crowded.select(F.col("fp").alias("mid"))
        star = ball.join(shuffled(hub), "mid").select(F.col("mid").alias("a"), F.col("fp").alias("b"))
    else:
        first = ball.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        star = ball.join(shuffled(first), "mid").select("a", F.col("fp").alias("b"))
    return pairs.union(star.where("a <> b").distinct())


def near_duplicate_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2, cell_cap: int = 64) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Null or wordless text has fingerprint zero and links like any other. Repeated rows and equal texts share a
    component. component_id is the smallest non-null doc_id reachable; rows with a null doc_id take part.
    """
    fp = save(fingerprints(docs, shingle), "fp")
    least = save(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(least.select("fp"), max_bits, cell_cap))
    rooted = least.join(counted(roots).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(shuffled(of_root), "root").select("fp", "component_id")
    return fp.join(shuffled(by_fp), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
