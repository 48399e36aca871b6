"""Many states at once: what an adaptive system asks of all its inactive states, as arrays with a row for each.

A repository grows with the stream, and all of it is weighed every few rows. An inactive state does not learn, so its
tree, fingerprints and records are laid out once per change of the active state, and a row of the active window is
predicted once by each tree. Results equal those of one state at a time, in the last digit too: sums are taken in the
same order (for windows of up to 129 rows).
"""

from __future__ import annotations

import math

import numpy as np

from .metafeatures import basic, normal_tail
from .tree import HoeffdingTree, Leaf


class AdwinBank:
    """Independent ADWINs with clock 1 that take a value each at the same time; see `adwin.Adwin`."""

    def __init__(self, size: int, delta: float, per_row: int = 5, least: int = 5):
        self.delta, self.per_row, self.least = delta, per_row, least
        self.logs = np.zeros(0)
        self.reset(size)

    def reset(self, size: int) -> None:
        self.width = np.zeros(size, np.int64)
        self.total, self.spread = np.zeros(size), np.zeros(size)
        self.sums, self.devs = (np.zeros((size, 4, self.per_row + 1)) for _ in range(2))  # by level; the oldest first
        self.count = np.zeros((size, 4), np.int64)

    def remove(self, row: int) -> None:
        for name in ("width", "total", "spread", "sums", "devs", "count"):
            setattr(self, name, np.delete(getattr(self, name), row, 0))

    @property
    def mean(self) -> np.ndarray:
        return self.total / np.maximum(self.width, 1)

    def variance(self, row: int) -> float:
        return float(self.spread[row] / self.width[row]) if self.width[row] else 0.0

    def add(self, values: np.ndarray) -> None:
        d = values - self.mean
        self.spread += np.where(self.width > 0, self.width * d * d / (self.width + 1), 0.0)
        self.width += 1
        self.total += values
        all_rows = np.arange(len(values))
        self.sums[all_rows, 0, self.count[:, 0]] = values
        self.devs[all_rows, 0, self.count[:, 0]] = 0.0
        self.count[:, 0] += 1
        self._compress()
        rows = np.flatnonzero(self.width > 2 * self.least)
        while len(rows):
            rows = rows[self._cuts(rows)]
            self._drop(rows)
            rows = rows[self.width[rows] > 2 * self.least]

    def _compress(self) -> None:
        level = 0
        while len(rows := np.flatnonzero(self.count[:, level] > self.per_row)):
            if level + 1 == self.count.shape[1]:
                self.sums, self.devs = (np.concatenate([a, np.zeros_like(a[:, :1])], 1) for a in (self.sums, self.devs))
                self.count = np.concatenate([self.count, np.zeros_like(self.count[:, :1])], 1)
            s1, s2 = self.sums[rows, level, 0], self.sums[rows, level, 1]
            v1, v2 = self.devs[rows, level, 0], self.devs[rows, level, 1]
            for a in (self.sums, self.devs):
                a[rows, level, :-2] = a[rows, level, 2:]
                a[rows, level, -2:] = 0.0
            self.count[rows, level] -= 2
            n = 1 << level
            d = s1 / n - s2 / n
            at = self.count[rows, level + 1]
            self.sums[rows, level + 1, at] = s1 + s2
            self.devs[rows, level + 1, at] = v1 + v2 + n * d * d / 2
            self.count[rows, level + 1] += 1
            level += 1

    def _log(self, width: np.ndarray) -> np.ndarray:
        top = int(width.max())
        if top >= len(self.logs):
            more = [math.log(2 * math.log(w) / self.delta) if w > 1 else 0.0 for w in range(len(self.logs), 2 * top + 1)]
            self.logs = np.concatenate([self.logs, more])
        return self.logs[width]

    def _cuts(self, rows: np.ndarray) -> np.ndarray:
        """Which rows have a cut point that parts two unlike means. Empty buckets repeat the point before them."""
        levels, slots = self.count.shape[1], self.per_row + 1
        s0 = self.sums[rows, ::-1].reshape(len(rows), -1).cumsum(1)
        held = np.arange(slots) < self.count[rows, ::-1, None]
        n0 = (held * (1 << np.arange(levels - 1, -1, -1))[:, None]).reshape(len(rows), -1).cumsum(1)
        width = self.width[rows, None]
        n1 = width - n0
        ok = (n0 >= self.least) & (n1 >= self.least)
        at, where = np.nonzero(ok)
        n0, n1, s0 = n0[at, where], n1[at, where], s0[at, where]
        u0, u1 = s0 / n0, (self.total[rows][at] - s0) / n1
        m = 1 / (n0 - self.least + 1) + 1 / (n1 - self.least + 1)
        d = self._log(self.width[rows])[at]
        variance = (self.spread[rows] / self.width[rows])[at]
        out = np.zeros(len(rows), bool)
        out[at[np.abs(u0 - u1) > np.sqrt(2 * m * variance * d) + 2 / 3 * m * d]] = True
        return out

    def _drop(self, rows: np.ndarray) -> None:
        """Forget the oldest bucket."""
        if not len(rows):
            return
        levels = self.count.shape[1]
        level = levels - 1 - (self.count[rows, ::-1] > 0).argmax(1)
        s, v = self.sums[rows, level, 0], self.devs[rows, level, 0]
        for a in (self.sums, self.devs):
            a[rows, level, :-1] = a[rows, level, 1:]
            a[rows, level, -1] = 0.0
        self.count[rows, level] -= 1
        n = 1 << level
        self.width[rows] -= n
        self.total[rows] -= s
        w = self.width[rows]
        d = s / n - self.total[rows] / w
        self.spread[rows] = np.maximum(0.0, self.spread[rows] - v - n * w * d * d / (n + w))


class FlatTree:
    """A tree that does not learn: nodes as arrays, leaves point to themselves."""

    __slots__ = ("feature", "threshold", "kids", "major", "bayes", "effect", "mean", "var", "logvar", "prior", "depth")

    def __init__(self, tree: HoeffdingTree):
        nodes, effects, todo, self.depth = [], [], [(tree.root, np.zeros(tree.features), 0)], 0
        kids, split = [], []
        while len(nodes) < len(todo):
            node, effect, depth = todo[len(nodes)]
            at = len(nodes)
            nodes.append(node)
            effects.append(effect)
            self.depth = max(self.depth, depth)
            if isinstance(node, Leaf):
                kids.append((at, at))
                split.append((0, np.inf))
                continue
            kids.append((len(todo), len(todo) + 1))
            split.append((node.feature, node.threshold))
            for child in (node.left, node.right):
                own = effect.copy()
                own[node.feature] += child.counts[0] - node.counts[0]
                todo.append((child, own, depth + 1))
        self.feature, self.threshold = np.array([f for f, _ in split]), np.array([t for _, t in split])
        self.kids, self.effect = np.array(kids), np.abs(np.array(effects))
        self.major = np.array([int(n.counts.argmax()) if isinstance(n, Leaf) and n.counts.any() else 0 for n in nodes])
        own = [n for n in nodes if isinstance(n, Leaf) and n.counts.any() and n.nb_right > n.mc_right and n.seen.any()]
        place = {id(n): i for i, n in enumerate(own)}
        self.bayes = np.array([place.get(id(n), -1) for n in nodes])
        shape = (0, tree.classes, tree.features)
        self.mean = np.array([n.mean for n in own]).reshape(-1, *shape[1:])
        self.var = np.array([np.maximum(n.spread / np.maximum(n.seen - 1, 1)[:, None], 1e-6) for n in own]).reshape(-1, *shape[1:])
        self.logvar = np.log(self.var)
        self.prior = np.array([np.where(n.seen > 0, np.log(np.where(n.seen > 0, n.counts, 1)), -np.inf) for n in own]).reshape(-1, tree.classes)


class Forest:
    """Flat trees side by side: each row's leaf in every tree, and the votes of leaves."""

    def __init__(self, trees: list[FlatTree]):
        sizes = np.array([len(t.feature) for t in trees])
        self.roots = np.cumsum(sizes) - sizes
        nb = np.array([len(t.mean) for t in trees])
        first = np.cumsum(nb) - nb
        join = lambda name: np.concatenate([getattr(t, name) for t in trees])
        self.feature, self.threshold, self.major, self.effect = join("feature"), join("threshold"), join("major"), join("effect")
        self.left, self.right = np.concatenate([t.kids + r for t, r in zip(trees, self.roots, strict=True)]).T.copy()
        self.bayes = np.concatenate([np.where(t.bayes >= 0, t.bayes + f, -1) for t, f in zip(trees, first, strict=True)])
        self.mean, self.var, self.logvar, self.prior = join("mean"), join("var"), join("logvar"), join("prior")
        self.depth = max(t.depth for t in trees)

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, vote), each trees x rows."""
        n, features = x.shape
        at = np.repeat(self.roots, n)
        row = np.tile(np.arange(n) * features, len(self.roots))
        flat = np.ascontiguousarray(x).ravel()
        for _ in range(self.depth):
            at = np.where(flat[row + self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        vote, kind = self.major[at], self.bayes[at]
        own = np.flatnonzero(kind >= 0)
        if len(own):
            k = kind[own]
            d = x[own % n][:, None, :] - self.mean[k]
            vote[own] = (-0.5 * (d * d / self.var[k] + self.logvar[k]).sum(2) + self.prior[k]).argmax(1)
        return at.reshape(-1, n), vote.reshape(-1, n)


def row_sums(a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the first n[i] values of each row, zeros after them, in the order in which numpy adds up to 128 values."""
    if a.shape[1] > 128:
        return a.sum(1)
    rows, full = np.arange(len(a)), n // 8
    wide = np.zeros((len(a), -(-a.shape[1] // 8) * 8 + 8))
    wide[:, : a.shape[1]] = a
    place = np.arange(wide.shape[1])
    lanes = np.where(place < 8 * full[:, None], wide, 0.0).reshape(len(a), -1, 8)
    r = lanes[:, 0].copy()
    for k in range(1, lanes.shape[1]):
        r += lanes[:, k]
    out = ((r[:, 0] + r[:, 1]) + (r[:, 2] + r[:, 3])) + ((r[:, 4] + r[:, 5]) + (r[:, 6] + r[:, 7]))
    for k in range(7):  # zeros follow the last value
        out = out + wide[rows, 8 * full + k]
    return out


def gap_statistics(right: np.ndarray) -> dict[str, np.ndarray]:
    """`metafeatures.basic` of the rows between errors, for each row of right (series x rows)."""
    who, at = np.nonzero(right == 0)
    errors = np.bincount(who, minlength=len(right))
    n = np.maximum(errors - 1, 0)
    same = who[1:] == who[:-1]
    gaps, who = (at[1:] - at[:-1])[same].astype(float), who[1:][same]
    starts = np.cumsum(n) - n
    width = max(int(n.max()), 3)
    held = np.arange(width) < n[:, None]
    x = np.zeros((len(right), width))
    x[who, np.arange(len(who)) - starts[who]] = gaps
    least = np.maximum(n, 1)
    m = row_sums(x, n) / least
    d = np.where(held, x - m[:, None], 0.0)
    d2 = d * d
    # Products of deviations that reach past the last value are zero.
    lagged = [np.pad(d[:, k:] * d[:, :-k], ((0, 0), (0, k))) for k in (1, 2)]
    parts = np.concatenate([d2, d2 * d, d2 * d2, *lagged])
    total, third, fourth, *lags = row_sums(parts, np.concatenate([n, n, n, *(np.maximum(n - k, 0) for k in (1, 2))])).reshape(5, -1)
    c0 = total / least
    ok = (c0 > 1e-14) & (n > 1)
    safe = np.where(ok, c0, 1.0)
    out = {
        "mean": m,
        "stdev": np.where(n > 1, np.sqrt(total / np.maximum(n - 1, 1)), 0.0),
        "skew": np.where(ok, third / least / safe**1.5, 0.0),
        "kurtosis": np.where(ok, fourth / least / safe**2 - 3, -3.0),
    }
    step = np.diff(x, axis=1)
    turns = (step[:, 1:] * step[:, :-1] < 0) & held[:, 2:]
    out["turning_point_rate"] = np.where(n > 2, turns.sum(1) / least, 0.0)
    r = {}
    for k in (1, 2):
        r[k] = np.where(ok & (n > k), lags[k - 1] / least / safe, 0.0)
        out[f"acf_{k}"] = r[k]
    u1 = np.where(n > 1, r[1] * n / np.maximum(n - 1, 1), 0.0)
    u2 = np.where(n > 2, r[2] * n / np.maximum(n - 2, 1), 0.0)
    left = 1 - u1 * u1
    out["pacf_1"] = u1
    out["pacf_2"] = np.where((n > 2) & (np.abs(left) > 1e-12), (u2 - u1 * u1) / np.where(np.abs(left) > 1e-12, left, 1), 0.0)
    return out


class Inactive:
    """All states but the active one, laid out as long as none of them changes: descriptions of rows of the active window by
    each, distances to their fingerprints, likelihoods."""

    def __init__(self, states: list, flat: dict[int, FlatTree], cache: int):
        self.states = states
        for s in states:
            if s.id not in flat:
                flat[s.id] = FlatTree(s.tree)
        self.forest = Forest([flat[s.id] for s in states])
        self.upto = self.base = 0
        self.leaf = np.zeros((len(states), 256), np.int32)
        self.vote = np.zeros((len(states), 256), np.int16)
        told = self.told = np.flatnonzero([s.print is not None for s in states])
        # A shorter list of fingerprints repeats the first, which leaves the least distance as it is.
        own = [[r.mean for r in (s.print, *s.cached)] for s in (states[i] for i in told)]
        self.prints = np.array([p + p[:1] * (cache + 1 - len(p)) for p in own]) if own else None
        samples = [[t for t in list(states[i].samples)[::5] if t[0]] for i in told]
        most = max((len(t) for t in samples), default=0)
        self.again = np.array([len(t) for t in samples])
        if most:
            blank = (1.0, np.zeros_like(own[0][0]), np.zeros_like(own[0][0]))
            full = [t + [blank] * (most - len(t)) for t in samples]
            self.old = np.array([[t[0] for t in row] for row in full])
            self.then, self.only = (np.array([[t[k] for t in row] for row in full]) for k in (1, 2))
        records = [np.fromiter(states[i].record, float) for i in told]
        self.usual = np.array([(r.mean(), r.std(ddof=1)) if len(r) > 1 else (np.nan, np.nan) for r in records]).reshape(-1, 2)
        self.ratio = np.array([states[i].adjusted[1] for i in told])
        self.ranges = self.version = None

    def _predict(self, w) -> None:
        """Predict the rows of the active window that are new; columns count from row `base` of all its rows."""
        first, end = w.moved + w.first, w.moved + w.end
        self.upto = max(self.upto, first)
        if end - self.base > self.leaf.shape[1]:
            kept = slice(max(first - self.base, 0), max(self.upto - self.base, 0))
            width = max(256, 2 * (end - first))
            for name in ("leaf", "vote"):
                old = getattr(self, name)
                new = np.zeros((len(old), width), old.dtype)
                new[:, : kept.stop - kept.start] = old[:, kept]
                setattr(self, name, new)
            self.base = first
        if self.upto < end:
            to = slice(self.upto - self.base, end - self.base)
            self.leaf[:, to], self.vote[:, to] = self.forest.apply(w.x[self.upto - w.moved : w.end])
            self.upto = end

    def describe(self, rows: slice, w, sources: list[str], kept: list[str]) -> np.ndarray:
        """States x signals; see `AdaptiveSystem._describe`."""
        self._predict(w)
        n, count = rows.stop - rows.start, len(self.states)
        at = slice(rows.start + w.moved - self.base, rows.stop + w.moved - self.base)
        x, y = w.x[rows], w.y[rows].astype(float)
        p = self.vote[:, at].T.astype(float, order="C")
        right = (p == y[:, None]).astype(float)
        both = basic(np.concatenate([p, right], axis=1))
        shared = basic(np.concatenate([x, y[:, None]], axis=1))
        gaps = gap_statistics(right.T) if "error_distances" in sources and n else None
        fi = self.forest.effect[self.leaf[:, at]].sum(1) if "FI" in kept else None
        out = np.zeros((count, len(sources), len(kept)))
        for i, name in enumerate(sources):
            for j, f in enumerate(kept):
                if name[0] == "f":
                    out[:, i, j] = fi[:, int(name[1:])] if f == "FI" else shared[f][int(name[1:])]
                elif f == "FI":
                    continue
                elif name == "labels":
                    out[:, i, j] = shared[f][-1]
                elif name == "error_distances":
                    out[:, i, j] = gaps[f]
                else:
                    out[:, i, j] = both[f][:count] if name == "predictions" else both[f][count:]
        return np.nan_to_num(out.reshape(count, -1))

    def likelihoods(self, system, v: np.ndarray) -> list[float]:
        """Of the state of each row of v, its description of the window."""
        out = [0.0] * len(self.states)
        if not len(self.told):
            return out
        w = system._weights()
        w = w / w.max() if w.max() > 0 else np.ones_like(w)
        if self.ranges != system.ranges:
            self.ranges, self.b = system.ranges, system._scaled(self.prints)
            if self.again.any():
                self.sa, self.sb = system._scaled(self.then), system._scaled(self.only)
        if self.version != system.version:
            self.version = system.version
            self.bb = (w * self.b * self.b).sum(-1)
            if system.o.adjust_similarity:
                self.ratio = np.ones(len(self.told))
                if self.again.any():
                    d = cosine((w * self.sa * self.sa).sum(-1), (w * self.sb * self.sb).sum(-1), (w * self.sa * self.sb).sum(-1))
                    self.ratio = np.array([sum(r[:k]) / k if k else 1.0 for r, k in zip((d / self.old).tolist(), self.again.tolist(), strict=True)])
        wa = w * (a := system._scaled(v[self.told]))
        d = cosine((wa * a).sum(-1)[:, None], self.bb, (wa[:, None] * self.b).sum(-1)).min(1)
        mean, sd = self.usual[:, 0] * self.ratio, np.clip(self.usual[:, 1] * self.ratio, system.o.min_sim_stdev, system.o.max_sim_stdev)
        for i, z in zip(self.told.tolist(), ((d - mean) / sd).tolist(), strict=True):
            out[i] = normal_tail(z) if z == z else 0.0
        return out


def cosine(aa: np.ndarray, bb: np.ndarray, ab: np.ndarray) -> np.ndarray:
    ok = (aa > 0) & (bb > 0)
    return np.where(ok, 1 - ab / np.sqrt(np.where(ok, aa * bb, 1.0)), np.where(aa == bb, 0.0, 1.0))
