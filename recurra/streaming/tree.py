"""Hoeffding tree with Gaussian observers and adaptive naive Bayes leaves, path attributions, and rules as SQL.

Domingos and Hulten (2000); leaves after Gama et al. (2003); attributions after Saabas (2014).
"""

from __future__ import annotations

import math

import numpy as np


class Leaf:
    __slots__ = ("counts", "seen", "mean", "spread", "low", "high", "last", "nb_right", "mc_right", "depth")

    def __init__(self, classes: int, features: int, counts: np.ndarray | None = None, depth: int = 0):
        self.counts = np.zeros(classes) if counts is None else counts.astype(float)
        self.seen = np.zeros(classes)  # what the observers have seen; counts may start from a split's estimate
        self.mean = np.zeros((classes, features))
        self.spread = np.zeros((classes, features))
        self.low, self.high = np.full(features, np.inf), np.full(features, -np.inf)
        self.last, self.nb_right, self.mc_right, self.depth = self.counts.sum(), 0.0, 0.0, depth


class Split:
    __slots__ = ("feature", "threshold", "left", "right", "counts")

    def __init__(self, feature: int, threshold: float, left: Leaf, right: Leaf, counts: np.ndarray):
        self.feature, self.threshold, self.left, self.right, self.counts = feature, threshold, left, right, counts


def bound(spread: float, confidence: float, n: float) -> float:
    return math.sqrt(spread * spread * math.log(1 / confidence) / (2 * n))


def _entropy(c: np.ndarray) -> np.ndarray:
    total = c.sum(-1, keepdims=True)
    p = np.divide(c, total, out=np.zeros_like(c), where=total > 0)
    return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)


def _gini(c: np.ndarray) -> np.ndarray:
    total = c.sum(-1, keepdims=True)
    p = np.divide(c, total, out=np.zeros_like(c), where=total > 0)
    return 1 - (p * p).sum(-1)


_erf = np.frompyfunc(math.erf, 1, 1)


class HoeffdingTree:
    """`evolution` rises with every split, so that others can tell when stored predictions are stale."""

    def __init__(self, classes: int, features: int, grace: int = 200, confidence: float = 1e-7, tie: float = 0.05, criterion: str = "info_gain", max_depth: int = 20, points: int = 10):
        if criterion not in ("info_gain", "gini"):
            raise ValueError("criterion must be info_gain or gini")
        self.classes, self.features = classes, features
        self.grace, self.confidence, self.tie, self.max_depth, self.points = grace, confidence, tie, max_depth, points
        self.impurity, self.spread = (_entropy, math.log2(max(classes, 2))) if criterion == "info_gain" else (_gini, 1.0)
        self.root: Leaf | Split = Leaf(classes, features)
        self.evolution = 0

    def _find(self, x: np.ndarray) -> tuple[Leaf, Split | None, bool]:
        node, parent, left = self.root, None, False
        while isinstance(node, Split):
            parent, left = node, x[node.feature] <= node.threshold
            node = node.left if left else node.right
        return node, parent, left

    def _bayes(self, leaf: Leaf, x: np.ndarray) -> np.ndarray:
        """Log votes of each row of x; classes without rows have none."""
        seen = leaf.seen > 0
        var = np.maximum(leaf.spread / np.maximum(leaf.seen - 1, 1)[:, None], 1e-6)
        d = x[:, None, :] - leaf.mean
        score = -0.5 * (d * d / var + np.log(var)).sum(2) + np.log(np.where(seen, leaf.counts, 1))
        return np.where(seen, score, -np.inf)

    def _vote(self, leaf: Leaf, x: np.ndarray) -> np.ndarray:
        if not leaf.counts.any():
            return np.zeros(len(x), int)
        if leaf.nb_right > leaf.mc_right and leaf.seen.any():
            return self._bayes(leaf, x).argmax(1)
        return np.full(len(x), int(leaf.counts.argmax()))

    def predict_one(self, x: np.ndarray) -> int:
        return int(self._vote(self._find(x)[0], x[None])[0])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), int)

        def go(node, rows):
            if not len(rows):
                return
            if isinstance(node, Leaf):
                out[rows] = self._vote(node, x[rows])
            else:
                left = x[rows, node.feature] <= node.threshold
                go(node.left, rows[left])
                go(node.right, rows[~left])

        go(self.root, np.arange(len(x)))
        return out

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Per row and feature how much the splits on its path move the first class's count."""
        out = np.zeros((len(x), self.features))

        def go(node, rows):
            if isinstance(node, Leaf) or not len(rows):
                return
            left = x[rows, node.feature] <= node.threshold
            for child, part in ((node.left, rows[left]), (node.right, rows[~left])):
                out[part, node.feature] += child.counts[0] - node.counts[0]
                go(child, part)

        go(self.root, np.arange(len(x)))
        return out

    def fit_one(self, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        node = self.root
        while isinstance(node, Split):
            node.counts[y] += weight
            node = node.left if x[node.feature] <= node.threshold else node.right
        leaf, parent, left = self._find(x)
        if leaf.counts.any():
            if leaf.counts.argmax() == y:
                leaf.mc_right += weight
            if leaf.seen.any() and self._bayes(leaf, x[None])[0].argmax() == y:
                leaf.nb_right += weight
        leaf.counts[y] += weight
        leaf.seen[y] += weight
        d = x - leaf.mean[y]
        leaf.mean[y] += d * weight / leaf.seen[y]
        leaf.spread[y] += weight * d * (x - leaf.mean[y])
        np.minimum(leaf.low, x, out=leaf.low)
        np.maximum(leaf.high, x, out=leaf.high)
        n = leaf.counts.sum()
        if n - leaf.last >= self.grace and leaf.depth < self.max_depth:
            leaf.last = n
            if (leaf.seen > 0).sum() > 1:
                self._try_split(leaf, parent, left)

    def _try_split(self, leaf: Leaf, parent: Split | None, left: bool) -> None:
        ok = leaf.high > leaf.low
        if not ok.any():
            return
        steps = np.arange(1, self.points + 1) / (self.points + 1)
        lo, hi = np.where(ok, leaf.low, 0), np.where(ok, leaf.high, 0)
        at = lo[:, None] + (hi - lo)[:, None] * steps
        sd = np.sqrt(np.maximum(leaf.spread / np.maximum(leaf.seen - 1, 1)[:, None], 1e-12))
        z = (at[None] - leaf.mean[:, :, None]) / (sd[:, :, None] * math.sqrt(2))
        share = 0.5 * (1 + _erf(z).astype(float))
        below = np.moveaxis(share * leaf.seen[:, None, None], 0, -1)
        above = leaf.seen - below
        n = leaf.seen.sum()
        gain = self.impurity(leaf.seen) - (below.sum(-1) * self.impurity(below) + above.sum(-1) * self.impurity(above)) / n
        gain[(np.minimum(below.sum(-1), above.sum(-1)) / n < 0.01) | ~ok[:, None]] = -np.inf
        best = gain.max(1)
        order = np.argsort(-best, kind="stable")
        top = best[order[0]]
        second = max(best[order[1]], 0.0) if len(order) > 1 else 0.0
        e = bound(self.spread, self.confidence, n)
        if top > 0 and (top - second > e or e < self.tie):
            f = int(order[0])
            k = int(gain[f].argmax())
            # Estimated counts let a fresh leaf vote; its observers start empty.
            children = [Leaf(self.classes, self.features, c, leaf.depth + 1) for c in (below[f, k], above[f, k])]
            split = Split(f, float(at[f, k]), *children, leaf.counts.copy())
            if parent is None:
                self.root = split
            elif left:
                parent.left = split
            else:
                parent.right = split
            self.evolution += 1

    def measure(self) -> dict[str, int]:
        leaves = depth = 0
        todo = [(self.root, 0)]
        while todo:
            node, d = todo.pop()
            depth = max(depth, d)
            if isinstance(node, Leaf):
                leaves += 1
            else:
                todo += [(node.left, d + 1), (node.right, d + 1)]
        return {"nodes": 2 * leaves - 1, "leaves": leaves, "depth": depth}

    def sql(self, x: str = "x") -> str:
        """The tree with majority leaves as one SQL CASE expression over an array column."""

        def go(node) -> str:
            if isinstance(node, Leaf):
                return str(int(node.counts.argmax()))
            return f"CASE WHEN {x}[{node.feature}] <= {node.threshold!r} THEN {go(node.left)} ELSE {go(node.right)} END"

        return go(self.root)
