"""Exact top-k inner-product search with dual cover trees.

Queries and candidates are both indexed: nodes of a cover tree over a bounded sample are the cells, and each vector
belongs to the cell with the nearest centre, whose covering radius is the largest distance found. A query first searches
the cell that promises most, which gives a lower bound of its k-th score; then it goes only to the cells whose centre
and radius allow as much. What is left of a cell and a group of queries builds a cover tree of each and walks both
together: a pair of nodes is left out when the largest inner product that their centres, norms and covering radii allow
is under the worst k-th score of the node's queries. The best of all cells meet in a ranked window, so the result is
exact.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

_EXACT = float(1 << 53)
#: Pairs of vectors that may be scored at once where their nodes' children leave nothing out.
_SMALL = 1 << 16


@dataclass
class Node:
    center: np.ndarray
    norm: float
    radius: float
    points: np.ndarray
    children: list[Node]


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def cover_tree(x: np.ndarray, leaf: int = 128, fan: int = 16) -> Node:
    """A cover tree over the rows of x, cut off at `leaf` points.

    A node's centre is also the centre of its first child. The further centres are chosen one by one, each the point
    furthest from those before; so at the scale of the largest child's radius the children cover the node and their
    centres lie at least that far apart. Equal points share a leaf, however many there are.
    """

    def make(points: np.ndarray, center: np.ndarray, dist: np.ndarray) -> Node:
        radius = float(dist.max()) * (1 + 1e-9) if len(dist) else 0.0
        node = Node(center, float(np.linalg.norm(center)), radius, points, [])
        if len(points) > leaf and radius > 0:
            todo.append((node, dist))
        return node

    todo: list[tuple[Node, np.ndarray]] = []
    first = x[0] if len(x) else np.zeros(x.shape[1])
    root = make(np.arange(len(x)), first, _distance(x, first))
    while todo:
        node, dist = todo.pop()
        own_rows = x[node.points]
        best, owner = dist.copy(), np.zeros(len(dist), int)
        centers = [node.center]
        while len(centers) < fan and best.max() > 0:
            c = own_rows[int(best.argmax())]
            d = _distance(own_rows, c)
            closer = d < best
            best[closer], owner[closer] = d[closer], len(centers)
            centers.append(c)
        for k, c in enumerate(centers):
            own = np.flatnonzero(owner == k)
            if len(own):
                node.children.append(make(node.points[own], c, best[own]))
    return root


def cell_centers(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of about `cells` nodes of a cover tree over x: the fullest node is opened until there are as many."""
    heap = [(-len(x), 0, cover_tree(x, leaf=max(1, len(x) // max(cells, 1))))]
    closed, count = [], 0
    while heap and len(heap) + len(closed) < cells:
        _, _, node = heapq.heappop(heap)
        if not node.children:
            closed.append(node)
        for child in node.children:
            count += 1
            heapq.heappush(heap, (-len(child.points), count, child))
    return np.stack([n.center for n in [*closed, *(h[2] for h in heap)]])


class _Best:
    """The k best (score, id) of each query; ties go to the smaller id. Scores are whole doubles under 2^53."""

    def __init__(self, n: int, k: int, least: np.ndarray | None):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k
        self.least = np.full(n, -np.inf) if least is None else least
        self.worst = self.least.copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score >= np.maximum(self.score[rows, -1], -1e300)[:, None]).any(1)
        if not better.any():
            return
        rows = rows[better]
        s = np.hstack([self.score[rows], score[better]])
        i = np.hstack([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))])
        if s.shape[1] > 4 * self.k:
            # All that reach the k-th score; only where ties reach over k columns is the whole row needed.
            most = np.argpartition(-s, 2 * self.k, axis=1)[:, : 2 * self.k]
            kth = -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1]
            if ((s >= kth[:, None]).sum(1) <= 2 * self.k).all():
                s, i = np.take_along_axis(s, most, 1), np.take_along_axis(i, most, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)
        self.worst[rows] = np.maximum(self.score[rows, -1], self.least[rows])

    def rows(self):
        row, place = np.nonzero(self.score > -np.inf)
        yield from zip(row.tolist(), self.id[row, place].tolist(), (int(s) for s in self.score[row, place]), strict=True)


class _LargeBest:
    """The same for integers of any size."""

    def __init__(self, n: int, k: int, least: np.ndarray | None):
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.k = k
        self.worst = np.full(n, -np.inf) if least is None else least.copy()

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for row, own in zip(rows.tolist(), score.tolist(), strict=True):
            new = [(-s, i) for s, i in zip(own, ids.tolist(), strict=True) if s is not None]
            self.best[row] = heapq.nsmallest(self.k, [*self.best[row], *new])
            if len(self.best[row]) == self.k:
                self.worst[row] = max(self.worst[row], _under(-self.best[row][-1][0]))

    def rows(self):
        yield from ((row, i, -s) for row, own in enumerate(self.best) for s, i in own)


def _under(s: int) -> float:
    """A double that is not over the integer."""
    try:
        return float(s) - abs(float(s)) * 1e-9
    except OverflowError:
        return 1.7e308 if s > 0 else -np.inf


def search_block(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int, least: np.ndarray | None = None):
    """The k best candidates of each query, none with the query's own id, and the share of pairs that was scored.

    least: scores that each query is known to reach; nodes and scores under them are left out.
    """
    # Sums of products stay exact in doubles below 2^53; beyond, Python's integers take over at the leaves.
    with np.errstate(over="ignore"):
        exact = q.shape[1] * max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) < _EXACT
    best = (_Best if exact else _LargeBest)(len(q), k, least)
    if not len(q) or not len(c):
        return best, 0.0
    qo, co = q, c
    if not exact:
        to_int = np.vectorize(int, otypes=[object])
        qo, co = to_int(q), to_int(c)

    def bound(a: Node, b: Node) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            top = float(a.center @ b.center) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
            top += 0.5 if exact else abs(top) * 1e-9 + a.norm * b.norm * 1e-9
        return top if top == top else np.inf

    heap: list = []
    count = scored = 0

    def push(a: Node, b: Node, top: float) -> None:
        nonlocal count
        count += 1
        heapq.heappush(heap, (-top, count, a, b))

    def score(a: Node, b: Node) -> None:
        nonlocal scored
        s = qo[a.points] @ co[b.points].T
        s[q_id[a.points][:, None] == c_id[b.points][None, :]] = -np.inf if exact else None
        scored += s.size
        best.add(a.points, s, c_id[b.points])

    roots = cover_tree(q, leaf=32), cover_tree(c)
    push(*roots, bound(*roots))
    while heap:
        top, _, a, b = heapq.heappop(heap)
        if -top < best.worst[a.points].min():
            continue
        if a.children and (not b.children or a.radius > b.radius):
            pairs = [(x, b) for x in a.children]
        else:
            pairs = [(a, x) for x in b.children]
        kept = [(x, y, t) for x, y in pairs if (t := bound(x, y)) >= best.worst[x.points].min()]
        # Opening a small pair that leaves nothing out would only cut the matrix product.
        sure = len(kept) == len(pairs) and best.worst[a.points].min() > -np.inf
        if not pairs or sure and len(a.points) * len(b.points) <= _SMALL:
            score(a, b)
        else:
            for x in kept:
                push(*x)
    return best, scored / (len(q) * len(c))


_LONG = (1 << 63) - 1


def _order(s: int) -> str | None:
    """For a score at or beyond the ends of a long: a text whose order is that of the numbers."""
    if -_LONG - 1 < s < _LONG:
        return None
    digits = str(abs(s))
    if s > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}{digits.translate(str.maketrans('0123456789', '9876543210'))}"


def _matrix(col, width: int, scale: float) -> np.ndarray:
    out = np.zeros((len(col), width))
    for i, v in enumerate(col):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -1.7e308, 1.7e308)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, block: int = 2048, query_block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding",
    cells: int = 1024, sample: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query, ties to the smaller id.

    Components x count as floor(scale * x), x as double. Rows whose vector is null or holds null or non-finite
    components take no part. Vectors of unlike lengths are padded with zeros. A candidate with the query's id is the
    query's own; other rows that repeat an id count each. Equal query rows give one result. Fewer than k candidates:
    all of them. Scores are compared as integers of any size; beyond a long the score that is shown is clamped. Other
    columns are not read. The index is fitted to `sample` vectors and has at most `cells` cells; every row is indexed. A
    cell of more than `block` rows is cut into parts by hash, so that equal vectors do not gather.
    """

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad).withColumn("h", F.xxhash64("id", "v"))

    spark = vectors.sparkSession
    found, asked = clean(vectors), clean(queries).distinct()
    size = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    asked_size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).first()
    if not size["n"] or not asked_size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(size["w"], asked_size["w"], 1)

    def nodes(rows: DataFrame, n: int):
        some = rows.orderBy("h").limit(sample).select("v").collect()
        return spark.sparkContext.broadcast(cell_centers(_matrix([r["v"] for r in some], width, scale), min(cells, n)))

    index = nodes(found, -(-size["n"] // block))
    centers = index.value

    def placing(shared):
        def run(batches):
            c = shared.value
            with np.errstate(over="ignore", invalid="ignore"):
                half = (c * c).sum(1) / 2
                for b in batches:
                    x = _matrix(b.column(1).to_pylist(), width, scale)
                    near = np.nan_to_num(x @ c.T - half, nan=-np.inf).argmax(1) if len(x) else np.zeros(0, int)
                    dist = np.nan_to_num(np.sqrt(((x - c[near]) ** 2).sum(1)), nan=np.inf, posinf=np.inf)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(dist)], names=["id", "v", "h", "cell", "dist"])

        return run

    def parts(counts: dict[int, int], rows: int, n: int = len(centers)) -> Column:
        """How many parts a cell of n has; one for cells that are not counted."""
        many = {c: -(-k // rows) for c, k in counts.items() if k > rows}
        if not many:
            return F.lit(1)
        return F.element_at(F.array(*[F.lit(many.get(i, 1)) for i in range(n)]), F.col("cell") + 1)

    schema = "id long, v array<double>, h long, cell int, dist double"
    placed = save(found.mapInArrow(placing(index), schema), "placed")
    stats = {r["cell"]: (r["n"], r["r"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()}
    block_parts = {c: n for c, (n, _) in stats.items()}
    placed = placed.select("id", "v", "cell", F.pmod("h", parts(block_parts, block)).cast("int").alias("part"))

    # Queries have nodes of their own, as few as `query_block` asks for, since a cell is sent to each group that wants it.
    around = nodes(asked, -(-asked_size["n"] // query_block))
    grouped = save(asked.mapInArrow(placing(around), schema), "queries")
    query_counts = {r["cell"]: r["count"] for r in grouped.groupBy("cell").count().collect()}
    slot = F.pmod("h", parts(query_counts, query_block, len(around.value)))
    grouped = grouped.select(F.col("h").alias("key"), "id", "v", F.concat_ws(":", "cell", slot).alias("group"))

    radius = np.full(len(centers), -1.0)
    for c, (_, r) in stats.items():
        radius[c] = r * (1 + 1e-9)
    filled = np.array([stats.get(i, (0, 0))[0] for i in range(len(centers))])
    summary = spark.sparkContext.broadcast((radius, filled))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        ids = q["id"].to_numpy(np.int64)
        best, _ = search_block(_matrix(q["v"], width, scale), ids, _matrix(c["v"], width, scale), c["id"].to_numpy(np.int64), k, q["least"].to_numpy(np.float64))
        out = [(row, i, max(-_LONG - 1, min(_LONG, s)), _order(s)) for row, i, s in best.rows()]
        row = [x[0] for x in out]
        return pd.DataFrame({"key": q["key"].to_numpy(np.int64)[row], "query_id": ids[row], "vec_id": [x[1] for x in out], "score": [x[2] for x in out], "beyond": pd.Series([x[3] for x in out], dtype=object)})

    found_schema = "key long, query_id long, vec_id long, score long, beyond string"

    def met(left: DataFrame) -> DataFrame:
        """Search of left (key, id, v, least, group, cell, part): each part of a cell goes to the groups that want it."""
        wanted = save(left.select("cell", "part", "group").distinct(), "wanted")
        right = placed.join(wanted, ["cell", "part"])
        on = ["cell", "part", "group"]
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(search, found_schema)

    order = [F.desc("score"), F.desc_nulls_last("beyond"), F.col("vec_id")]

    def reach(rows: DataFrame) -> DataFrame:
        """rows (key, id, v, group, least) plus the cells that may hold a score of `least` or more, and the best one."""

        def run(batches):
            c, (r, n) = index.value, summary.value
            norms = np.sqrt((c * c).sum(1))
            for b in batches:
                x = _matrix(b.column(2).to_pylist(), width, scale)
                least = b.column(4).to_numpy(zero_copy_only=False)
                own = np.sqrt((x * x).sum(1))[:, None]
                with np.errstate(over="ignore", invalid="ignore"):
                    middle = x @ c.T
                    top = middle + own * r + np.abs(middle) * 1e-9 + own * norms * 1e-9 + 0.5
                middle, top = np.nan_to_num(middle, nan=-1e300), np.nan_to_num(top, nan=np.inf)
                ok = (top >= least[:, None]) & (n > 0)
                # Cells with too few rows for k scores promise nothing.
                home = np.where(n > k, middle, np.where(n > 0, -1e305, -np.inf)).argmax(1)
                offsets = np.concatenate([[0], np.cumsum(ok.sum(1))])
                allowed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.nonzero(ok)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*b.columns, allowed, pa.array(home.astype(np.int32))], names=["key", "id", "v", "group", "least", "cells", "home"])

        told = rows.select("key", "id", "v", "group", "least").mapInArrow(run, "key long, id long, v array<double>, group string, least double, cells array<int>, home int")
        return save(told, "reach")

    start = grouped.withColumn("least", F.lit(float("-inf")))
    if len(stats) > 1:
        first = reach(start).withColumns({"cell": F.col("home"), "part": F.lit(0)}).drop("cells", "home")
        place_of = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))
        kth = met(first).withColumn("r", place_of).where(F.col("r") == k)
        least = kth.select("key", F.col("query_id").alias("id"), (F.col("score") - F.abs("score") * 1e-9 - 1).alias("floor"))
        start = grouped.join(save(least, "least"), ["key", "id"], "left").withColumn("least", F.coalesce("floor", F.lit(float("-inf"))))
    wide = reach(start).withColumn("cell", F.explode("cells"))
    left = wide.withColumn("part", F.explode(F.sequence(F.lit(0), (parts(block_parts, block) - 1).cast("int")))).drop("cells", "home")
    near = met(left)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "key").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
