"""Near copies by Jaccard similarity on word shingles: SimHash links first, then all candidates there can be, exactly.

The set of a text's shingles is a fingerprint with one bit for each hash value. The popcounts of 512 segments of it, the
numbers of shingles in ranges of the hash, are kept as their parities: the Hamming distance of two texts' parities never
exceeds that of their sets, and texts of a similarity have a Hamming distance of (1 - s) / (1 + s) of their sizes at most.
So the parities leave out candidates before their shingles are compared.

Candidates come from two sides. The 64-bit SimHash fingerprints at two or fewer bits meet by the grid range join of
`simhash.links`; that finds close copies, but texts at 0.8 differ in 5 to 14 bits. A prefix filter gives the rest: texts of
the similarity share one of their rarest shingles, whatever order shingles are in. Every candidate is verified by the exact
similarity, so groups are the components of all pairs at the similarity or more.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, collect_garbage, components, counted, release, save, shuffled, slices
from .simhash import _bit_counts, _majority, _pieces, links

#: Counters of the shingle order; several shingles may share one, which only makes the order less sharp.
_TALLIES, _SLOTS = 1 << 18, 64
#: Longs of a text's parities, one bit for each segment.
_LONGS = 8
_SEGMENTS = 64 * _LONGS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TEXT = ["doc_id", "h1", "h2"]


class _WordHashes(dict):
    """XXH64 by word; a bounded number of short words is kept."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 42)
        if len(self) < 300_000 and len(word) < 40:
            self[word] = h
        return h


def _runs(w: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` word hashes."""
    m = len(w) - size + 1
    h = w[:m].copy()
    for k in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + w[k : k + m]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes | None, size: int, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` lower-cased words; fewer words: the whole sequence; none: empty."""
    parts, kept = [], np.zeros(0, np.uint64)
    for piece in _pieces(text or b""):
        w = np.fromiter(map(words.__getitem__, piece), np.uint64, len(piece))
        w = np.concatenate([kept, w])
        if len(w) >= size:
            parts.append(_runs(w, size))
            kept = w[len(w) - size + 1 :]
        else:
            kept = w
    if not parts:
        return _runs(kept, len(kept)) if len(kept) else kept
    return np.unique(parts[0] if len(parts) == 1 else np.concatenate(parts))


def parities(h: np.ndarray) -> np.ndarray:
    """The last bits of the numbers of shingles in each segment, the high bits of the hash, as longs."""
    odd = np.bincount((h >> np.uint64(65 - _SEGMENTS.bit_length())).astype(np.int64), minlength=_SEGMENTS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _within(similarity: float, a: str, b: str) -> Column:
    """Whether sizes and parities, columns size and odd after the prefixes a and b, allow the similarity."""
    apart = sum(F.bit_count(F.get(f"{a}odd", F.lit(i)).bitwiseXOR(F.get(f"{b}odd", F.lit(i)))) for i in range(_LONGS))
    return apart <= (F.col(f"{a}size") + F.col(f"{b}size")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text) of the rows with a doc_id; h1 and h2 are 128 bits that stand for the text, null as empty."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *_halves(F.col("text")), "text")


def _halves(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def _tallies(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many texts hold the shingles of each counter, the low bits of the hash."""

    def count(batches):
        words = _WordHashes()
        total = np.zeros(_TALLIES, np.int64)
        held, n = [], 0
        for b in (part for whole in batches for part in slices(whole)):
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.append((shingle_set(t, shingle, words) & np.uint64(_TALLIES - 1)).astype(np.int64))
                n += len(held[-1])
                if n > _TALLIES:
                    total += np.bincount(np.concatenate(held), minlength=_TALLIES)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=_TALLIES)
        parts = [x.tobytes() for x in total.reshape(_SLOTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLOTS), pa.int32()), pa.array(parts, pa.binary())], names=["slot", "tally"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_TALLIES // _SLOTS, np.int64)
        for x in group.column("tally").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"slot": group.column("slot")[:1], "tally": pa.array([total.tobytes()], pa.binary())})

    schema = "slot int, tally binary"
    got = texts.select("text").mapInArrow(count, schema).groupBy("slot").applyInArrow(add, schema).collect()
    parts = [np.frombuffer(bytes(r.tally), np.int64) for r in sorted(got, key=lambda r: r.slot)]
    return np.concatenate(parts) if parts else np.zeros(_TALLIES, np.int64)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


#: A shingle whose counter is higher may be in so many prefixes that its group is dealt to `_SALTS` tasks.
_HOT, _SALTS = 1 << 20, 64


def _described(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Per row its place (rid), the size of its shingle set, its fingerprint, parities, and rarest shingles.

    Two sets of the similarity share one of their first size - ceil(similarity * size) + 1 shingles under any one order
    of all shingles (prefix filter). Rare ones come first, so that a common passage gives few candidates. Those from place
    `cold` on have hot counters.
    """
    hot = _HOT
    shared = texts.sparkSession.sparkContext.broadcast(_tallies(texts, shingle))

    def run(batches):
        tallies, words = shared.value, _WordHashes()
        rid = TaskContext.get().partitionId() << 40
        for b in (part for whole in batches for part in slices(whole)):
            fp, sizes, odd, cold, keys = [], [], [], [], []
            for t in b.column(3).cast(pa.binary()).to_pylist():
                h = shingle_set(t, shingle, words)
                often = tallies[(h & np.uint64(_TALLIES - 1)).astype(np.int64)]
                order = np.argsort(often, kind="stable")
                first = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1 if len(h) else 0
                sizes.append(len(h))
                fp.append(_majority(_bit_counts(h), len(h)) if len(h) else 0)
                odd.append(parities(h))
                cold.append(int((often <= hot).sum()))
                keys.append(h[order[:first]].view(np.int64))
            rids = np.arange(rid, rid + len(sizes))
            rid += len(sizes)
            columns = [*b.columns[:3], pa.array(rids), pa.array(sizes, pa.int64()), pa.array(fp, pa.int64()), _lists(odd, pa.int64()), pa.array(cold, pa.int32()), _lists(keys, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*_TEXT, "rid", "size", "fp", "odd", "cold", "keys"])

    return texts.mapInArrow(run, "doc_id long, h1 long, h2 long, rid long, size long, fp long, odd array<long>, cold int, keys array<long>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def run(batches):
        words = _WordHashes()
        for b in (part for whole in batches for part in slices(whole)):
            sets = [shingle_set(t, shingle, words).view(np.int64) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets, pa.int64())], names=["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


class _Judge:
    """Verifies candidate pairs of nodes and keeps what was found."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, repeated: DataFrame, shingle: int, similarity: float):
        self.texts, self.nodes, self.shingle, self.similarity = texts, nodes, shingle, similarity
        self.repeated = None if repeated.isEmpty() else repeated
        self.judged: DataFrame | None = None
        self.roots: DataFrame | None = None

    def __call__(self, pairs: DataFrame, bounded: bool = False) -> None:
        """pairs (a, b), a < b; bounded: their parities have been compared. Afterwards roots maps each node that has a link
        to that of its component, of `alike` nodes."""
        if self.judged is not None:
            pairs = pairs.join(shuffled(self.judged.select("a", "b")), ["a", "b"], "left_anti")
        pairs = save(pairs, "pairs")
        near = save(by_ids(self.nodes, _ends(pairs), "left_semi", "node"), "near")
        if bounded:
            told, wanted, used = pairs.withColumn("open", F.lit(True)), near.select("node", *_TEXT), [pairs, near]
        else:
            told = pairs.join(shuffled(near.select(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("odd").alias("a_odd"))), "a")
            told = told.join(shuffled(near.select(F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("odd").alias("b_odd"))), "b")
            told = save(told.select("a", "b", _within(self.similarity, "a_", "b_").alias("open")), "bounded")
            wanted = save(near.join(shuffled(_ends(told.where("open")).distinct()), "node").select("node", *_TEXT), "wanted")
            used = [pairs, near, told, wanted]
        rows = by_ids(self.texts, wanted, "inner", _TEXT)
        if self.repeated is not None:
            again = by_ids(rows, self.repeated, "left_semi", _TEXT).dropDuplicates(["node"])
            rows = by_ids(rows, self.repeated, "left_anti", _TEXT).unionByName(again)
        sets = save(_sets(rows, self.shingle), "sets")
        common = F.size(F.array_intersect("xa", "xb"))
        alike = (
            told.where("open")
            .join(shuffled(sets.select(F.col("node").alias("a"), F.col("shingles").alias("xa"))), "a")
            .join(shuffled(sets.select(F.col("node").alias("b"), F.col("shingles").alias("xb"))), "b")
            .select("a", "b", (common / (F.size("xa") + F.size("xb") - common) >= self.similarity).alias("same"))
        )
        new = save(alike.unionByName(told.where("not open").select("a", "b", F.lit(False).alias("same"))), "judged")
        release(*used, sets)
        self.judged = new if self.judged is None else self.judged.unionByName(new)
        if self.roots is None or not new.where("same").isEmpty():
            self._link(new.where("same").select("a", "b"))
        collect_garbage(self.texts.sparkSession)

    def _link(self, edges: DataFrame) -> None:
        """Join components by edges between them; links inside a component are not followed again."""
        old = self.roots
        if old is not None:
            for end in ("a", "b"):
                edges = by_roots(edges.withColumnRenamed(end, "node"), old).withColumnRenamed("root", end).drop("node", "alike")
            edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        roots = joined = components(edges)
        if old is not None:
            moved = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
            known = old.select("node", "root").join(counted(moved), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            roots = known.unionByName(joined.join(shuffled(old.select("node")), "node", "left_anti"))
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("alike"))
        self.roots = save(roots.join(shuffled(sizes), "root").select("node", "root", "alike"), "roots")
        if old is not None:
            release(old)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _close_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (a, b) of nodes with equal fingerprints or linked ones: each with the first of its SimHash component only.

    Components come from the grid range join of all fingerprints at `max_bits` or fewer bits.
    """
    leads = save(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "leads")
    roots = components(links(leads.select("fp"), max_bits)).withColumnsRenamed({"node": "fp", "root": "root_fp"})
    roots = leads.join(shuffled(roots), "fp", "left").withColumn("root_fp", F.coalesce("root_fp", "fp"))
    first = roots.join(shuffled(leads.select(F.col("fp").alias("root_fp"), F.col("lead").alias("a"))), "root_fp").select("fp", "a")
    both = nodes.select("node", "fp").join(shuffled(first), "fp").where("a <> node")
    return both.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))


def _open_groups(left: DataFrame, judge: _Judge) -> DataFrame:
    """left (key, node, size, place, degree) with roots, without the groups of one component; alike: nodes of the root."""
    left = by_roots(left, judge.roots)
    several = left.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    out = save(left.join(shuffled(several), "key", "left_semi"), "left")
    collect_garbage(out.sparkSession)
    return out


def by_roots(left: DataFrame, roots: DataFrame) -> DataFrame:
    """left with root and alike of each node; a node without links is its own."""
    return left.join(counted(roots), "node", "left").withColumns({"root": F.coalesce("root", "node"), "alike": F.coalesce("alike", F.lit(1))})


def _groups(docs: DataFrame, shingle: int, similarity: float, max_bits: int, leaders: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h1, h2, keeper) of every distinct row that has a doc_id, keeper a struct of the same three; and the
    rows (doc_id, h1, h2) that the table holds more than once."""
    texts = _texts(docs)
    seen = save(_described(texts, shingle, similarity), "described")
    exact = save(seen.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid")), "exact")
    repeated = save(seen.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_TEXT), "repeated")
    # One row stands for all equal texts. Its number is unique, and mixed, so that components take few rounds.
    first = by_ids(seen.where("size > 0"), exact, "left_semi", "rid").withColumn("node", F.xxhash64("rid"))
    nodes = save(first.select("node", *_TEXT, "size", "fp", "odd"), "nodes")
    judge = _Judge(texts, nodes, repeated, shingle, similarity)
    judge(_close_pairs(nodes, max_bits))

    keyed = first.select("node", "size", "cold", F.posexplode("keys").alias("place", "key"))
    salt = F.when(F.col("place") >= F.col("cold"), F.pmod("node", F.lit(_SALTS)) + 1).otherwise(F.lit(0))
    crowd = F.count(F.lit(1)).over(Window.partitionBy("key", "salt"))
    keyed = keyed.select("key", salt.alias("salt"), "node", "size", "place").withColumn("n", crowd)
    met = save(keyed.where("n > 1 or salt > 0").drop("salt"), "met")
    ids = save(seen.select(*_TEXT).distinct(), "ids")
    release(seen)
    collect_garbage(docs.sparkSession)
    # A text that others were made from meets more of them than they meet each other; it should lead.
    degree = save(met.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    left = _open_groups(by_ids(met.drop("n"), degree, "inner", "node"), judge)
    release(met, degree)
    later = False
    while not left.isEmpty():
        # Members of small components lead first: with them gone, the group is one component.
        order = Window.partitionBy("key").orderBy("alike", F.desc("degree"), "node")
        leads = left.withColumn("r", F.row_number().over(order)).where(F.col("r") <= leaders)
        odd = ["odd"] * later
        leads = save(leads.select("key", *(F.col(c).alias(f"lead_{c}") for c in ("node", "root", "size", "place", *odd))), "leads")
        # At the first shingle that two similar texts share, none before it counts and enough must come after it.
        after = F.least(F.col("size") - F.col("place"), F.col("lead_size") - F.col("lead_place"))
        enough = after >= (F.col("size") + F.col("lead_size")) * (similarity / (1 + similarity)) - 1e-6
        pairs = left.join(shuffled(leads) if later else counted(leads), "key").where((F.col("root") != F.col("lead_root")) & enough)
        if later:
            pairs = pairs.where(_within(similarity, "", "lead_"))
        judge(pairs.select(F.least("lead_node", "node").alias("a"), F.greatest("lead_node", "node").alias("b")).distinct(), later)
        # A leader has met all of its group. What is left can link only members of different components.
        rest = left.drop("root", "alike").join(counted(leads).select("key", F.col("lead_node").alias("node")), ["key", "node"], "left_anti")
        if not later:
            # Few groups are left, with many pairs: from now on the join of members and leaders compares parities.
            rest, later = rest.join(shuffled(nodes.select("node", "odd")), "node"), True
        old, left = left, _open_groups(rest, judge)
        release(old, leads)
        leaders = min(16 * leaders, max(leaders, 512))

    own = F.struct(F.col("least").alias("doc_id"), "h1", "h2")
    rooted = by_roots(nodes.select("node", "h1", "h2").join(shuffled(judge.roots.select("node")), "node", "left_semi"), judge.roots)
    rooted = rooted.join(shuffled(exact.select("h1", "h2", "least")), ["h1", "h2"])
    keepers = rooted.join(shuffled(rooted.groupBy("root").agg(F.min(own).alias("keeper"))), "root").select("h1", "h2", "keeper")
    named = save(exact.join(shuffled(keepers), ["h1", "h2"], "left").select("h1", "h2", F.coalesce("keeper", own).alias("keeper")), "named")
    return ids.join(shuffled(named), ["h1", "h2"]).select(*_TEXT, "keeper"), repeated


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2, leaders: int = 2) -> DataFrame:
    """(doc_id, keeper): documents that repeat another one, with the smallest doc_id of their group.

    Groups are the components of all pairs of texts whose shingle sets have the Jaccard similarity or more, whatever
    their length; no pair of it is missed. Candidates are verified exactly; in a group of candidates, members are compared
    with `leaders` of them, those that meet most others, and again without those, with sixteen times as many leaders up to
    512, until all that are left are of one component: only pairs whose link is known from other pairs stay untested.
    Equal texts are one; null and wordless texts are equal to each other only if byte-equal (null as empty).
    Rows with a null doc_id are never listed. A doc_id with several texts is listed if one of them is a repeat.
    """
    groups, _ = _groups(docs, shingle, similarity, max_bits, leaders)
    return groups.where("keeper.doc_id <> doc_id").select("doc_id", F.col("keeper.doc_id").alias("keeper")).distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int = 2, leaders: int = 2) -> DataFrame:
    """`docs` with one document of each group of near copies, the one with the smallest doc_id.

    Columns are kept as they are. Of rows that repeat doc_id and text one stays; unlike texts that share a doc_id are
    documents of their own; rows with a null doc_id all stay.
    """
    groups, repeated = _groups(docs, shingle, similarity, max_bits, leaders)
    drop = groups.where(F.struct(*_TEXT) != F.col("keeper")).select(*(F.col(c).alias(f"__{c}") for c in _TEXT))
    drop = save(drop, "drop")
    marked = docs.withColumns({"__doc_id": F.col("doc_id").cast("long"), **dict(zip(("__h1", "__h2"), _halves(F.coalesce("text", F.lit(""))), strict=True))})
    on = [f"__{c}" for c in _TEXT]
    kept = by_ids(marked, drop, "left_anti", on)
    if not repeated.isEmpty():
        twice = repeated.select(*(F.col(c).alias(f"__{c}") for c in _TEXT))
        again = by_ids(kept, twice, "left_semi", on).dropDuplicates(on)
        kept = by_ids(kept, twice, "left_anti", on).unionByName(again)
    return kept.select(*docs.columns)
