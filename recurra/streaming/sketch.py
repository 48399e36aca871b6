"""Frequent Directions matrix sketch: mergeable, with bounded rows."""

from __future__ import annotations

import numpy as np


class FrequentDirections:
    """Keeps `ell` directions of the rows seen; up to twice as many rows between rotations. Zero rows are ignored."""

    def __init__(self, dims: int, ell: int):
        self.ell, self.held = ell, np.zeros((0, dims))
        self.seen = 0

    def append(self, row: np.ndarray) -> None:
        self.seen += 1
        if row.any():
            self.held = np.vstack([self.held, row])
            if len(self.held) >= 2 * self.ell:
                self._rotate()

    def _rotate(self) -> None:
        """All directions lose what the first one beyond `ell` has; so `ell` of them stay."""
        _, s, v = np.linalg.svd(self.held, full_matrices=False)
        if len(s) > self.ell:
            s = np.sqrt(np.maximum(s[: self.ell] ** 2 - s[self.ell] ** 2, 0))
            v = v[: self.ell]
        self.held = (s[:, None] * v)[s > 0]

    def observations(self) -> np.ndarray:
        """The sketch as rows of the data's scale: for each direction what one row seen holds of it in the mean."""
        return self.rows() * np.sqrt(1 / max(self.seen, 1)) * np.sqrt(len(self.held))

    def column(self, i: int) -> np.ndarray:
        """A column of the sketch at the data's scale."""
        return self.observations()[:, i]

    def column_range(self, i: int) -> tuple[float, float]:
        c = self.column(i)
        return (float(c.min()), float(c.max())) if len(c) else (0.0, 0.0)

    def column_histogram(self, i: int, bins: int = 10, ends: tuple[float, float] | None = None) -> np.ndarray:
        """Counts of a column's values in equal bins over its range, or over `ends`; the last bin has its upper edge."""
        lo, hi = ends or self.column_range(i)
        if hi <= lo:
            out = np.zeros(bins, int)
            out[-1] = len(self.held)
            return out
        return np.histogram(np.clip(self.column(i), lo, hi), bins=bins, range=(lo, hi))[0]

    def similarity(self, v: np.ndarray, mean: np.ndarray, weights: np.ndarray | None = None) -> float:
        """Least weighted cosine distance of a vector to the sketch's directions and to the mean vector."""
        w = np.ones(len(v)) if weights is None else weights
        best = None
        for row in (*self.rows(), mean):
            a, b = float((w * v * v).sum()), float((w * row * row).sum())
            d = 1 - abs(float((w * v * row).sum())) / (a * b) ** 0.5 if a > 0 and b > 0 else float(a != b)
            best = d if best is None else min(best, d)
        return best

    def merge(self, other: FrequentDirections) -> FrequentDirections:
        self.seen += other.seen
        self.held = np.vstack([self.held, other.held])
        while len(self.held) >= 2 * self.ell:
            self._rotate()
        return self

    def rows(self) -> np.ndarray:
        if len(self.held) > self.ell:
            self._rotate()
        return self.held


def sketch_groups(rows, key: str, vector: str, ell: int):
    """(key, row, v): the sketch of each group's vectors, built per input batch and merged per group.

    The partial sketches go through the shuffle, not the rows, so a group that holds most rows is spread over the tasks
    that read it.
    """
    from pyspark.sql import functions as F

    kind = rows.schema[key].dataType.simpleString()

    def partial(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for n, pdf in enumerate(batches):
            for k, part in pdf.groupby("k"):
                s = FrequentDirections(len(part["v"].iloc[0]), ell)
                for v in part["v"]:
                    s.append(np.asarray(v, float))
                yield _frame(k, s, f"{task:08d}:{n:08d}")

    def merged(key_, pdf):
        total = None
        for _, part in pdf.groupby("part"):
            m = np.stack(part["v"].to_numpy())
            s = FrequentDirections(m.shape[1], ell)
            s.held, s.seen = m, int(part["seen"].iloc[0])
            total = s if total is None else total.merge(s)
        return _frame(key_[0], total, "")[["k", "row", "v", "seen"]]

    def _frame(k, s, part):
        import pandas as pd

        held = s.rows()
        if not len(held):
            held = np.zeros((1, held.shape[1]))
        return pd.DataFrame({"k": k, "part": part, "row": range(len(held)), "v": list(held), "seen": s.seen})

    schema = f"k {kind}, part string, row int, v array<double>, seen long"
    parts = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInPandas(partial, schema)
    done = parts.groupBy("k").applyInPandas(merged, f"k {kind}, row int, v array<double>, seen long")
    return done.withColumnRenamed("k", key)
