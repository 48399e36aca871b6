"""Benchmark decontamination by greedy string tiling.

Every document is scanned once for seeds, runs of `seed` words that it shares with a benchmark item, by running
Karp-Rabin hashes. Where there are any, the item and the document's words in seeds are tiled: the longest match that is
still unmarked is marked, again and again, and no word is marked twice. The share of the item that its tiles cover does
not depend on their order, so reordered passages are caught.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of benchmark text that one pass holds in each task; more items take further passes.
BLOCK_CHARS = 8_000_000
_PIECE = 1 << 20
_PUNCT = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
_TABLE = bytes.maketrans(_PUNCT.encode(), b" " * len(_PUNCT))
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation separates like white space."""
    return (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()


#: An odd number and its inverse modulo 2^64, so that the weight of a window's first word can be divided out.
_Q = 0xD6E8FEB86659FD93
_Q_INVERSE = pow(_Q, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2^64, of each run of n ids, from running sums: the cost does not depend on n."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(2)) * _P1
    x = (x ^ (x >> np.uint64(29))) * _P2
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(_Q, len(x)), dtype=np.uint64)])
    return (total[n:] - total[:-n]) * _powers(_Q_INVERSE, len(x) - n + 1)


#: Pairs of equal seeds that are held at once while the matches of an item and a document are listed.
PAIRS = 1 << 21


def _matches(item: np.ndarray, doc: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, place in the item, place in the document) of every maximal match of `least` words or more.

    Seeds of `least` words that lie next to each other on a diagonal are one match. Seed pairs are listed in blocks of the
    document; a match that goes on in the next block is put together again.
    """
    own = _windows(item, least)
    order = np.argsort(own, kind="stable")
    own = own[order]
    h = _windows(doc, least)
    lo, hi = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
    count = hi - lo
    some = np.flatnonzero(count)
    block = (np.cumsum(count[some]) - 1) // PAIRS
    parts = []
    for part in np.split(some, np.flatnonzero(np.diff(block)) + 1):
        k = count[part]
        b = np.repeat(part, k)
        a = order[np.repeat(lo[part], k) + np.arange(len(b)) - np.repeat(np.cumsum(k) - k, k)]
        same = np.ones(len(b), bool)
        for i in range(least):
            same &= item[a + i] == doc[b + i]
        a, b = a[same], b[same]
        line = np.lexsort((a, b - a))
        a, b = a[line], b[line]
        new = np.ones(len(a), bool)
        new[1:] = (b[1:] - a[1:] != b[:-1] - a[:-1]) | (a[1:] != a[:-1] + 1)
        first = np.flatnonzero(new)
        parts.append((b[first] - a[first], a[first], np.diff(np.append(first, len(a)))))
    if not parts:
        return
    diagonal, a, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    line = np.lexsort((a, diagonal))
    diagonal, a, n = diagonal[line], a[line], n[line]
    new = np.ones(len(a), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (a[1:] != a[:-1] + n[:-1])
    first = np.flatnonzero(new)
    if len(first):
        yield from zip((np.add.reduceat(n, first) + least - 1).tolist(), a[first].tolist(), (a + diagonal)[first].tolist(), strict=True)


def tile(item: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Mask of the item's words covered by greedy tiles of at least `least` words, longest first.

    Negative ids in `doc` match nothing. Ties go to the earlier place in the item, then in the document. What an earlier
    tile leaves of a match waits for its turn at its new length.
    """
    used_item, used_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    queue = [(-n, a, b) for n, a, b in _matches(item, doc, least)]
    heapq.heapify(queue)
    left = len(item)
    while queue and left >= least:
        n, a, b = heapq.heappop(queue)
        taken = used_item[a : a - n] | used_doc[b : b - n]
        if not taken.any():
            used_item[a : a - n] = used_doc[b : b - n] = True
            left += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if stop - start >= least:
                heapq.heappush(queue, (start - stop, a + start, b + start))
    return used_item


class _Block:
    """Some benchmark items with the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed, self.vocab, self.items = seed, {}, []
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words(text)]
            if ids:
                self.items.append((item_id, np.array(ids, np.int64)))
        self.own = [np.unique(_windows(ids, min(seed, len(ids)))) for _, ids in self.items]
        # Items of fewer words than a seed have their own seed length, all their words.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {min(seed, len(ids)) for _, ids in self.items}:
            pairs = [(h, i) for i, (_, ids) in enumerate(self.items) if min(seed, len(ids)) == n for h in self.own[i].tolist()]
            pairs.sort()
            self.seeds[n] = np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs])

    def find(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        """(item_id, words of the item, words covered) of each item with a seed in the text."""
        get = self.vocab.get
        own = words(text)
        doc = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
        known = np.concatenate([[0], np.cumsum(doc < 0)])
        for n, (hashes, which) in self.seeds.items():
            if len(doc) < n:
                continue
            starts = np.flatnonzero(known[n:] == known[:-n])
            if not len(starts):
                continue
            h = _windows(doc, n)[starts]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            some = np.flatnonzero(hi > lo)
            for i in np.unique(np.concatenate([which[a:b] for a, b in {*zip(lo[some].tolist(), hi[some].tolist(), strict=True)}] or [np.zeros(0, int)])).tolist():
                item_id, ids = self.items[i]
                at = starts[some][np.isin(h[some], self.own[i])]
                # Only words in a seed can be in a tile; one -1 parts runs that do not touch.
                mask = np.zeros(len(doc) + 1, np.int64)
                mask[at] += 1
                np.add.at(mask, at + n, -1)
                inside = np.cumsum(mask)[:-1] > 0
                near = inside.copy()
                near[1:] |= inside[:-1]
                yield item_id, len(ids), int(tile(ids, np.where(inside, doc, -1)[near], n).sum())


def _bench_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in order of id, in blocks of about `limit` characters; only one block is on the driver at a time."""
    block, chars = [], 0
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    for r in items.orderBy("item_id", "text").toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars >= limit:
            yield block
            block, chars = [], 0
    if block:
        yield block


_SCHEMA = "doc_id long, item_id long, item_words int, covered int, coverage double"


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, covered, coverage): the items that a document holds to `coverage` or more.

    Whole texts are scanned. Null or empty texts and items match nothing. Items shorter than `seed` words must
    occur whole. Repeated rows, of documents or items, are reported as often as they occur; a null doc_id or item_id is
    reported as null.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _bench_blocks(benchmark, block_chars):
        part = _pass(rows, items, seed, coverage)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _SCHEMA)


def _pass(rows: DataFrame, items: list[tuple[int, str]], seed: int, coverage: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        block = _Block(shared.value, seed)
        for b in batches:
            out = [
                (d, *hit, hit[2] / hit[1])
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                for hit in block.find(t)
                if hit[2] >= coverage * hit[1]
            ]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["doc_id", "item_id", "item_words", "covered", "coverage"],
            )

    return rows.mapInArrow(run, _SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, coverage: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """`docs`, columns as they are, without the rows whose text holds a benchmark item to `coverage` or more.

    Rows are judged one by one, so null ids, repeated rows and clashing column names do not matter; items count whether
    or not they have an id.
    """
    at = docs.columns.index("text")
    for items in _bench_blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            block = _Block(shared.value, seed)
            for b in batches:
                bad = [any(c >= coverage * n for _, n, c in block.find(t)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array([not x for x in bad], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
