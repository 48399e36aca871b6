"""The adaptive systems: one object per stream that predicts, learns, describes its windows and switches concepts.

`AdaptiveSystem` keeps a repository of states, each with a classifier, fingerprints and likelihood estimators. It switches
by likelihoods times transition priors under a statistical bound, and at drifts. `FingerprintSystem` is the simpler
variant that reacts to drifts of the similarity only. Both take rows one by one in order; batch replay and streaming
drive the same object, so they agree row by row.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

import numpy as np

from .adwin import Adwin
from .bank import AdwinBank, Inactive, cosine
from .metafeatures import DEFAULT_IGNORE, FEATURES, describe, error_gaps, normal_tail
from .tree import HoeffdingTree

PERFORMANCE = ("labels", "predictions", "errors", "error_distances")


#: Weightings of signals; those with bins use normals spread over them.
WEIGHTINGS = frozenset({"fisher_overall", "fisher", "original", "uniform", "None", "gaussian_approx", "CacheMIHy"})
SIMILARITIES = frozenset({"metainfo", "accuracy", "euclid", "jaccard", "jmahal"})


@dataclass
class Options:
    """Parameters and defaults of a run; names that are not known are refused."""

    classes: int = 2
    window_size: int = 100
    min_window_ratio: float = 0.65
    sensitivity: float = 0.05
    sim_gap: int = 5
    fp_gap: int = 15
    na_fp_gap: int = 50
    ob_gap: int = 5
    min_sim_stdev: float = 0.015
    max_sim_stdev: float = 0.175
    sim_stdevs: float = 3.0
    buffer_ratio: float = 0.2
    fingerprint_grace_period: int = 10
    state_grace_windows: int = 10
    bypass_grace_threshold: float = 0.2
    estimator_risk: float = 0.5
    swap_risk: float = 0.75
    min_likelihood: float = 0.005
    min_drift_likelihood: float = 0.175
    min_estimated_likelihood: float = 0.2
    merge_threshold: float = 0.95
    merge: bool = True
    background_prior: float = 0.4
    zero_prob: float = 0.7
    multihop_penalty: float = 0.7
    prev_state_prior: float = 50.0
    map_selection: bool = False
    fit_weight: int = 6
    recent_cap: int = 2000
    fingerprint_cache: int = 5
    similarity_buffer: int = 49
    normaliser_grace: int = 5
    weighting: str = "fisher_overall"
    similarity: str = "metainfo"
    bins: int = 10
    ignore_features: tuple[str, ...] = DEFAULT_IGNORE
    ignore_sources: tuple[str, ...] = ()
    forced_drifts: frozenset[int] = frozenset()
    learn: bool = True
    adjust_similarity: bool = True
    impute_labels: bool = False

    def __post_init__(self) -> None:
        for name, value, known in (("weighting", self.weighting, WEIGHTINGS), ("similarity", self.similarity, SIMILARITIES)):
            if value not in known:
                raise ValueError(f"unknown {name} {value!r}; one of {sorted(known)}")


class Running:
    """Mean and sample stdev of vectors, with weights."""

    def __init__(self, v: np.ndarray):
        self.mean, self.m2, self.seen = v.copy(), np.zeros_like(v), np.ones_like(v)

    def add(self, v: np.ndarray, weight: float = 1.0) -> None:
        self.seen += weight
        d = v - self.mean
        self.mean += d * weight / self.seen
        self.m2 += weight * d * (v - self.mean)

    @property
    def stdev(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.m2, 0) / np.maximum(self.seen - 1, 1))

    def reset(self, where: np.ndarray, v: np.ndarray) -> None:
        """Start over at v for some signals."""
        self.mean[where], self.m2[where], self.seen[where] = v[where], 0.0, 1.0

    def copy(self) -> Running:
        out = Running(self.mean)
        out.m2, out.seen = self.m2.copy(), self.seen.copy()
        return out


class Window:
    """Recent rows of a state as ring arrays: x, y, and the state's own predictions."""

    def __init__(self, features: int, cap: int):
        self.x, self.y, self.p = np.zeros((2 * cap, features)), np.zeros(2 * cap, int), np.zeros(2 * cap, int)
        self.cap, self.first, self.end = cap, 0, 0
        self.moved = 0  # rows that have left the arrays

    def __len__(self) -> int:
        return self.end - self.first

    def add(self, x: np.ndarray, y: int, p: int) -> None:
        if self.end == len(self.y):
            n = len(self)
            for a in (self.x, self.y, self.p):
                a[:n] = a[self.first : self.end].copy()
            self.moved += self.first
            self.first, self.end = 0, n
        self.x[self.end], self.y[self.end], self.p[self.end] = x, y, p
        self.end += 1
        if len(self) > self.cap:
            self.first += 1

    def keep(self, n: int) -> None:
        self.first = max(self.first, self.end - n)

    def part(self, start: int, stop: int) -> slice:
        return slice(self.first + start, self.first + stop)


class Others:
    """How a state describes windows in which other states were active: means and numbers, a row for each."""

    def __init__(self) -> None:
        self.at: dict[int, int] = {}
        self.mean = self.seen = np.zeros((0, 0))

    def __len__(self) -> int:
        return len(self.at)

    def add(self, id_: int, v: np.ndarray) -> None:
        i = self.at.get(id_)
        if i is None:
            i = self.at[id_] = len(self.at)
            if i >= len(self.mean):
                mean, seen = self.mean, self.seen
                self.mean, self.seen = np.zeros((2 * i + 2, len(v))), np.zeros((2 * i + 2, 1))
                if i:
                    self.mean[:i], self.seen[:i] = mean, seen
            self.mean[i], self.seen[i] = v, 1.0
        else:
            self.seen[i] += 1.0
            self.mean[i] += (v - self.mean[i]) / self.seen[i]

    def drop(self, id_: int) -> None:
        i = self.at.pop(id_, None)
        if i is not None:
            self.at = {k: j - (j > i) for k, j in self.at.items()}
            self.mean, self.seen = np.delete(self.mean, i, 0), np.delete(self.seen, i, 0)


@dataclass
class State:
    """likelihood and posterior are of the background state only; those of the others are in the system's banks."""

    id: int
    tree: HoeffdingTree
    window: Window
    likelihood: Adwin
    posterior: Adwin
    print: Running | None = None
    cached: deque = field(default_factory=deque)
    others: Others = field(default_factory=Others)
    record: deque = field(default_factory=deque)
    samples: deque = field(default_factory=deque)
    adjusted: tuple[int, float] = (-1, 1.0)
    dirty: int = 0
    seen: int = 0
    since: int = 0
    since_print: int = 0
    since_others: int = 0
    since_reset: int = 0
    unfit: int = 0
    visits: int = 0
    evolution: int = 0
    stable: bool = False
    now: float = 0.0
    head: np.ndarray | None = None


class AdaptiveSystem:
    """See the module. Inner windows are never longer than `recent_cap` rows, so a state is bounded in size."""

    columns = ("p", "active_model", "change_detected", "model_evolution", "similarity", "likelihoods", "priors", "posteriors", "merges", "deletions")

    def __init__(self, features: int, options: Options | None = None):
        self.o = options or Options()
        self.features = features
        names = [f"f{i}" for i in range(features)]
        self.sources = [s for s in [*names, *PERFORMANCE] if s not in self.o.ignore_sources and not (s in names and "features" in self.o.ignore_sources)]
        kept = [f for f in FEATURES if f not in self.o.ignore_features]
        self.bound = np.array([s in PERFORMANCE or f == "FI" for s in self.sources for f in kept])
        self.size = len(self.bound)
        self.low, self.high = np.full(self.size, np.inf), np.full(self.size, -np.inf)
        self.overall: Running | None = None
        self.warm = 0
        self.weights = np.ones(self.size)
        self.stale = True
        self.states: dict[int, State] = {}
        self.next_id = 0
        self.counts: dict[str, dict[int, dict[int, float]]] = {"standard": {}, "change": {}, "drift": {}}
        # Sums of the likelihoods of two states, the earlier one first: 1, u, v, u * u, v * v, u * v.
        self.pairs, self.pair_ids = np.zeros((2, 6, 0, 0)), []
        self.likelihood, self.posterior = AdwinBank(0, self.o.estimator_risk), AdwinBank(0, self.o.estimator_risk)
        self.batched = self.o.similarity == "metainfo" and not any(f == "MI" or f.startswith("IMF") for f in kept)
        self.kept = kept
        self.guess: tuple[np.ndarray | None, int] = (None, 0)  # the newest row and its prediction by the active state
        self.flat: dict = {}
        self.inactive: tuple[int, Inactive] | None = None
        self.layout = self.changes = self.ranges = 0
        self.base_priors: tuple | None = None
        self.prints: tuple | None = None
        self.touched: set[int] = set()
        self.own: dict[int, np.ndarray] = {}
        self.example = 0
        self.detector = Adwin(self.o.sensitivity, clock=max(1, self.o.sim_gap - 1))
        self.bg_detector = Adwin(self.o.sensitivity, clock=max(1, self.o.sim_gap - 1))
        self.warning = self._warning_detector()
        self.last_warning = 0
        self.version = 0
        self.active = self._new_state().id
        self.background = self._make(-1)
        self.previous = self.active
        self.min_rows = int(self.o.window_size * self.o.min_window_ratio)
        self.merges: list[str] = []
        self.deletions: list[str] = []

    # --- states ---

    def _warning_detector(self) -> Adwin:
        """Twice as sensitive as the drift detector; it starts anew whenever it fires."""
        return Adwin(min(1.0, 2 * self.o.sensitivity), clock=max(1, self.o.sim_gap - 1))

    def _watch(self, likelihood: float) -> bool:
        """Feed the likelihood of the active state; whether it fell. A warning marks the row it came at."""
        if self.warning.fell(likelihood):
            self.last_warning = self.example
            self.warning = self._warning_detector()
        return self.detector.fell(likelihood)

    def _make(self, id_: int) -> State:
        o = self.o
        return State(id_, HoeffdingTree(o.classes, self.features), Window(self.features, o.recent_cap), Adwin(o.estimator_risk, clock=1), Adwin(o.estimator_risk, clock=1))

    def _new_state(self) -> State:
        s = self._make(self.next_id)
        self.next_id += 1
        self.states[s.id] = s
        s.visits = 1
        self._members()
        self.likelihood.reset(len(self.states))
        self.posterior.reset(len(self.states))
        return s

    def _members(self) -> None:
        """States have come, gone or changed places: what is laid out for all of them is made again."""
        self.layout += 1
        self.prints = self.inactive = None

    def _inactive(self) -> Inactive | None:
        """All other states side by side, if there are any and the options allow it."""
        if not self.batched or len(self.states) < 2:
            return None
        if self.inactive is None or self.inactive[0] != self.layout:
            self.flat = {k: v for k, v in self.flat.items() if k in self.states}
            self.inactive = self.layout, Inactive([s for s in self.states.values() if s.id != self.active], self.flat, self.o.fingerprint_cache)
        return self.inactive[1]

    def predict(self, x: np.ndarray) -> int:
        p = self.states[self.active].tree.predict_one(x)
        self.guess = x, p
        return p

    def _buffer(self, s: State) -> int:
        want = math.floor(self.o.buffer_ratio * ((s.seen + s.since) / 2 + 1))
        return max(0, min(want, len(s.window) - 1))

    def _observe(self, s: State, x: np.ndarray, y: int) -> None:
        """Label the row; fit the newest row that has left the buffer, each once."""
        known = s.id == self.active and self.guess[0] is x
        s.window.add(x, y, self.guess[1] if known else s.tree.predict_one(x))
        if known:
            self.guess = (None, 0)
        s.seen += 1
        s.since += 1
        s.unfit = min(s.unfit + 1, len(s.window))
        if s.dirty:
            s.dirty -= 1
            if not s.dirty and s.print is not None:
                # All rows of a window are of the new model now: performance signals start over with clean ones.
                self._cache_print(s)
                s.since_reset = 0
        if not self.o.learn:
            return
        while s.unfit > self._buffer(s):
            at = s.window.end - s.unfit
            s.tree.fit_one(s.window.x[at], int(s.window.y[at]), self.o.fit_weight)
            s.unfit -= 1
        if s.tree.evolution != s.evolution:
            self._evolved(s)

    def _evolved(self, s: State) -> None:
        """The model has changed: label its history again.

        For a window's length descriptions are of a transition: performance signals start over with the next one, and again
        with the first that holds only rows of the new model.
        """
        s.evolution = s.tree.evolution
        rows = s.window.part(0, len(s.window))
        s.window.p[rows] = s.tree.predict(s.window.x[rows])
        s.dirty, s.since_reset = self.o.window_size, 0
        if s.print is not None:
            self._cache_print(s)

    def _cache_print(self, s: State) -> None:
        s.cached.append(s.print.copy())
        while len(s.cached) > self.o.fingerprint_cache:
            s.cached.popleft()

    # --- descriptions ---

    def _describe(self, s: State, rows: slice, w: Window | None = None) -> np.ndarray:
        """Meta-features of rows of a window; of another state's window, the state's own predictions are made."""
        own = w is None
        w = w or s.window
        x, y = w.x[rows], w.y[rows].astype(float)
        p = (w.p[rows] if own else s.tree.predict(x)).astype(float)
        right = (p == y).astype(float)
        series, importance = [], []
        fi = np.abs(s.tree.attributions(x)).sum(0) if "FI" not in self.o.ignore_features else np.zeros(self.features)
        named = {"labels": y, "predictions": p, "errors": right}
        for name in self.sources:
            if name[0] == "f":
                i = int(name[1:])
                series.append(x[:, i])
                importance.append(fi[i])
            else:
                series.append(error_gaps(right) if name == "error_distances" else named[name])
                importance.append(0.0)
        v = np.nan_to_num(describe(series, np.array(importance), self.o.ignore_features))
        return v

    def _head(self, s: State) -> slice:
        n = len(s.window)
        return s.window.part(max(0, n - self.o.window_size), n)

    def _stable(self, s: State) -> slice | None:
        """The oldest window of the rows before the buffer."""
        n = len(s.window) - self._buffer(s)
        n_rows = min(max(n, 0), self.o.window_size)
        return s.window.part(n - n_rows, n) if n_rows >= self.min_rows else None

    def _learn_range(self, v: np.ndarray) -> None:
        lo, hi = np.minimum(self.low, v), np.maximum(self.high, v)
        if (lo < self.low).any() or (hi > self.high).any():
            self.stale = True
            self.ranges += 1
            self.own.clear()
        self.low, self.high = lo, hi
        if self.overall is None:
            self.overall = Running(v)
        else:
            self.overall.add(v)
        self.warm += 1

    def _scaled(self, v: np.ndarray) -> np.ndarray:
        width = self.high - self.low
        return np.where(width > 0, (v - self.low) / np.where(width > 0, width, 1), 0.5)

    @staticmethod
    def _between(means: np.ndarray, seen: np.ndarray) -> np.ndarray:
        p = seen / seen.sum(0)
        mu = (p * means).sum(0)
        return (p * (means - mu) ** 2).sum(0)

    @staticmethod
    def _fisher(between: np.ndarray, sd: np.ndarray) -> np.ndarray:
        return np.where(sd > 0, between / np.where(sd > 0, sd, 1) ** 2, 0.0)

    def _all_prints(self) -> tuple[list[State], np.ndarray, np.ndarray, np.ndarray]:
        """States with a fingerprint, and the means, stdevs and numbers of all fingerprints."""
        if self.prints is None:
            own = [s for s in self.states.values() if s.print is not None]
            arrays = [np.array([get(s.print) for s in own]) for get in (lambda r: r.mean, lambda r: r.stdev, lambda r: r.seen)]
            self.prints = own, *arrays
        elif self.touched:
            own, mean, stdev, seen = self.prints
            for i, s in enumerate(own):
                if s.id in self.touched:
                    mean[i], stdev[i], seen[i] = s.print.mean, s.print.stdev, s.print.seen
        self.touched.clear()
        return self.prints

    def _weights(self) -> np.ndarray:
        if not self.stale:
            return self.weights
        self.stale = False
        self.version += 1
        prints, mean, stdev, seen = self._all_prints()
        if not prints or self.overall is None or self.o.weighting in ("uniform", "None"):
            self.weights = np.ones(self.size)
            return self.weights
        width = self.high - self.low
        ok = width > 0
        safe = np.where(ok, width, 1)
        means, sds = (mean - self.low) / safe, stdev / safe
        scale = 0.01 / np.maximum((seen * sds).sum(0) / seen.sum(0), 0.01)
        if len(prints) < 2:
            w = scale
        elif self.o.weighting == "original":
            w = means.std(0) * scale
        elif self.o.weighting in ("gaussian_approx", "CacheMIHy"):
            w = self._gaussian_mi(means, sds, seen) * scale
        else:
            within = self.o.weighting == "fisher"
            sd = np.sqrt((seen * sds**2).sum(0) / seen.sum(0)) if within else self.overall.stdev / safe
            w = self._fisher(self._between(means, seen), sd)
            own = []
            for s in prints:
                if k := len(s.others):
                    if s.id not in self.own:
                        m = (np.concatenate([s.print.mean[None], s.others.mean[:k]]) - self.low) / safe
                        self.own[s.id] = self._between(m, np.concatenate([s.print.seen[None], np.broadcast_to(s.others.seen[:k], (k, self.size))]))
                    own.append(self.own[s.id])
            if own:
                w = np.maximum(w, np.mean(self._fisher(np.array(own), sd), axis=0))
            w = w * scale
        w = np.where(ok & np.isfinite(w), w, np.nan)
        least = np.nanmin(w) if np.isfinite(w).any() else 0.01
        self.weights = np.where(np.isnan(w), least, w)
        return self.weights

    def _gaussian_mi(self, means: np.ndarray, sds: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Mutual information of a signal's bin and the state, from normals in equal bins of the unit range."""
        edges = np.linspace(0, 1, self.o.bins + 1)[1:-1]
        z = (edges[:, None, None] - means) / np.maximum(sds, 0.01)
        cdf = 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))
        mass = np.diff(np.concatenate([np.zeros((1, *means.shape)), cdf, np.ones((1, *means.shape))]), axis=0) * seen
        total = mass.sum((0, 1))

        def h(c):
            p = c / np.maximum(c.sum(0), 1e-12)
            return -(p * np.log2(np.where(p > 0, p, 1))).sum(0)

        given = (h(mass) * seen).sum(0) / np.maximum(total, 1e-12)
        return np.maximum(h(mass.sum(1)) - given, 0)

    def _distance(self, s: State, v: np.ndarray, only: np.ndarray | None = None) -> float | None:
        """Least weighted distance of a description to the state's fingerprint and its cached ones, or to `only`."""
        if s.print is None:
            return None
        if self.o.similarity == "metainfo":
            return float(self._cosines(v, np.array([r.mean for r in (s.print, *s.cached)] if only is None else [only])).min())
        w = self._weights()
        w = w / w.max() if w.max() > 0 else np.ones_like(w)
        a = self._scaled(v)
        best = None
        for r in (s.print, *s.cached) if only is None else (only,):
            b = self._scaled(r.mean if only is None else r)
            if self.o.similarity == "accuracy":
                d = float(np.abs(a - b)[self.bound].mean())
            elif self.o.similarity == "euclid":
                d = float(np.sqrt((w * (a - b) ** 2).sum()))
            elif self.o.similarity == "jaccard":
                either = (a != 0) | (b != 0)
                d = float((either & (a != b)).sum() / max(either.sum(), 1))
            else:
                aa, bb = float((w * a * a).sum()), float((w * b * b).sum())
                d = 1 - float((w * a * b).sum()) / math.sqrt(aa * bb) if aa > 0 and bb > 0 else (0.0 if aa == bb else 1.0)
                if self.o.similarity == "jmahal":
                    either = (a != 0) | (b != 0)
                    d = math.exp(d) + float((either & (a != b)).sum() / max(either.sum(), 1))
            best = d if best is None else min(best, d)
        return best

    def _cosines(self, v: np.ndarray, means: np.ndarray) -> np.ndarray:
        """Weighted cosine distances of a description, or of one for each row, to rows of means."""
        w = self._weights()
        w = w / w.max() if w.max() > 0 else np.ones_like(w)
        a, b = self._scaled(v), self._scaled(means)
        return cosine((w * a * a).sum(-1), (w * b * b).sum(-1), (w * a * b).sum(-1))

    def _likelihood(self, s: State, d: float | None) -> float:
        if d is None or len(s.record) < 2:
            return 0.0
        mean, sd = self._usual(s)
        return normal_tail((d - mean) / sd)

    def _usual(self, s: State) -> tuple[float, float]:
        """Mean and clamped stdev of the state's recorded distances, as they would be measured now.

        Weights and ranges change after a distance has been recorded; so every fifth is measured again, and the record
        takes the mean ratio of new to old.
        """
        if self.o.adjust_similarity:
            self._weights()
            if s.adjusted[0] != self.version:
                again = [t for t in list(s.samples)[::5] if t[0]]
                if self.o.similarity == "metainfo" and again:
                    found = self._cosines(np.array([t[1] for t in again]), np.array([t[2] for t in again])).tolist()
                else:
                    found = [self._distance(s, v, only) for _, v, only in again]
                again = [(t[0], new) for t, new in zip(again, found, strict=True)]
                s.adjusted = (self.version, sum(new / old for old, new in again) / len(again) if again else 1.0)
        r = np.fromiter(s.record, float)
        ratio = s.adjusted[1]
        return float(r.mean()) * ratio, min(max(float(r.std(ddof=1)) * ratio, self.o.min_sim_stdev), self.o.max_sim_stdev)

    def _take_print(self, s: State) -> None:
        """Record the similarity of the stable window, then take it into the fingerprint."""
        rows = self._stable(s)
        if rows is None:
            return
        v = self._describe(s, rows)
        self._learn_range(v)
        if self.warm < self.o.normaliser_grace:
            return
        if s.print is None:
            s.print, self.prints = Running(v), None
        else:
            if self.o.similarity == "metainfo":
                far = self._cosines(v, np.array([r.mean for r in (s.print, *s.cached)])).tolist()
            else:
                far = [self._distance(s, v, r.mean) for r in (s.print, *s.cached)]
            d, nearest = min((d, i) for i, d in enumerate(far))
            s.record.append(d)
            s.samples.append((d, v, (s.print, *s.cached)[nearest].mean.copy()))
            while len(s.record) > self.o.similarity_buffer:
                s.record.popleft()
                s.samples.popleft()
            s.print.add(v)
            if s.since_reset == 0:
                s.print.reset(self.bound, v)
        s.since_reset += 1
        self.touched.add(s.id)
        self.own.pop(s.id, None)
        self.stale = True

    # --- transitions ---

    def _count(self, name: str, a: int, b: int, n: float = 1.0) -> None:
        row = self.counts[name].setdefault(a, {})
        row[b] = row.get(b, 0.0) + n
        self.changes += name == "change"

    def _record_transition(self, a: int, b: int, drift: bool) -> None:
        if drift:
            self._count("drift", a, b)
        if a != b:
            first = b not in self.counts["change"].get(a, {})
            self._count("change", a, b)
            if first and self.o.prev_state_prior:
                self._count("change", b, a, self.o.prev_state_prior)
        self._count("standard", a, b)

    def _chances(self, name: str, a: int) -> dict[int, float]:
        row = self.counts[name].get(a, {})
        total = sum(row.values())
        return {k: v / total for k, v in row.items()} if total else {}

    def _smooth(self, p: float, penalty: float) -> float:
        return p * penalty * (1 - self.o.zero_prob) + self.o.zero_prob

    def _priors(self, drift: bool) -> dict[int, float]:
        """The largest of the smoothed chances of a state in one row, one change and two changes."""
        a, q = self.active, self.o.multihop_penalty
        key = (a, self.changes, self.layout)
        if self.base_priors is None or self.base_priors[0] != key:
            one = self._chances("change", a)
            two: dict[int, float] = {}
            for mid, p in one.items():
                for b, r in self._chances("change", mid).items():
                    two[b] = two.get(b, 0.0) + p * r
            none = self._smooth(0, 1)
            self.base_priors = key, {k: max(none, self._smooth(one.get(k, 0), q), self._smooth(two.get(k, 0), q * q)) for k in self.states}
        out = dict(self.base_priors[1])
        for k, p in self._chances("change" if drift else "standard", a).items():
            if k in out:
                out[k] = max(self._smooth(p, 1), out[k])
        return out

    def _switch(self, to: State, drift: bool) -> None:
        old = self.states[self.active]
        if to.id == -1:
            to.id = self.next_id
            self.next_id += 1
            self.states[to.id] = to
            to.visits = 0
        self.previous = self.active
        self._record_transition(old.id, to.id, drift)
        self.active = to.id
        to.visits += 1
        if not old.stable and old.visits < 2 and old.id != to.id and len(self.states) > 1:
            self._delete(old.id)
        to.since = 0
        to.unfit = 0
        to.window.keep(self.min_rows if to.seen else 0)
        if old.id in self.states:
            old.window.keep(self.min_rows)
            old.unfit = 0
        self.detector.reset()
        self.warning = self._warning_detector()
        self._reset_background()
        self._members()
        self.likelihood.reset(len(self.states))
        self.posterior.reset(len(self.states))

    def _reset_background(self) -> None:
        self.background = self._make(-1)
        self.bg_detector.reset()

    def _delete(self, id_: int) -> None:
        """Forget a state; what was counted to and from it goes to the state before it."""
        del self.states[id_]
        self.deletions.append(str(id_))
        self._fold(id_, self.previous if self.previous != id_ else self.active)

    def _fold(self, old: int, new: int) -> None:
        for m in self.counts.values():
            for b, n in m.pop(old, {}).items():
                m.setdefault(new, {})
                m[new][b] = m[new].get(b, 0.0) + n
            for row in m.values():
                if old in row:
                    row[new] = row.get(new, 0.0) + row.pop(old)
        for s in self.states.values():
            s.others.drop(old)
        self.own.clear()
        self._members()
        self.stale = True

    def _merge(self) -> None:
        """Fold states whose likelihoods move together into the one seen longest."""
        ids = list(self.states)  # in order of id
        if ids != self.pair_ids:
            kept = [i for i, k in enumerate(self.pair_ids) if k in self.states]
            to = [ids.index(self.pair_ids[i]) for i in kept]
            old, self.pairs = self.pairs[0], np.zeros((2, 6, len(ids), len(ids)))
            self.pairs[0][np.ix_(range(6), to, to)] = old[np.ix_(range(6), kept, kept)]
            self.pair_ids = ids
        states = list(self.states.values())
        u = np.array([s.now for s in states])
        old, new = self.pairs
        for t, one, z in zip(old, new, (1.0, u[:, None], u, (u * u)[:, None], u * u, u[:, None] * u), strict=True):
            np.add(t, z, out=one)
        self.pairs = self.pairs[::-1]
        grace = self.o.state_grace_windows * self.o.window_size
        long = np.flatnonzero([s.seen >= grace for s in states])
        again = np.array([s.visits >= 2 for s in states])[long]
        a, b = np.nonzero(np.triu(again[:, None] | again, 1) & (new[0][np.ix_(long, long)] >= 30))
        a, b = long[a], long[b]
        n, su, sv, suu, svv, suv = new[:, a, b]
        vu, vv = suu - su * su / n, svv - sv * sv / n
        ok = (vu > 1e-9) & (vv > 1e-9)
        like = ok & ((suv - su * sv / n) / np.sqrt(np.where(ok, vu * vv, 1.0)) > self.o.merge_threshold)
        if not like.any():
            return
        i, j = (int(z[like.argmax()]) for z in (a, b))
        # Pairs after this one are not counted at this row.
        place = np.arange(len(ids))
        after = (place[:, None] > i) | ((place[:, None] == i) & (place > j))
        new[:, after] = old[:, after]
        sa, sb = states[i], states[j]
        keep, drop = (sa, sb) if (sa.seen, -sa.id) >= (sb.seen, -sb.id) else (sb, sa)
        if drop.id == self.active:
            self.active = keep.id
        del self.states[drop.id]
        for bank in (self.likelihood, self.posterior):
            bank.remove(ids.index(drop.id))
        self._fold(drop.id, keep.id)
        self.merges.append(f"{drop.id}:{keep.id}")

    def _beats(self, a: int, b: int) -> bool:
        """Whether the posterior of the state at place b is above that at place a by more than the bound allows."""
        n0, n1 = int(self.posterior.width[a]), int(self.posterior.width[b])
        if n0 < 2 or n1 < 2:
            return False
        u0, u1 = (float(self.posterior.total[i] / n) for i, n in ((a, n0), (b, n1)))
        if self.o.map_selection:
            return u1 > u0
        m = 1 / (1 / n0 + 1 / n1)
        d = math.log(2 * math.log(n0 + n1) / self.o.swap_risk)
        return u1 > u0 and u1 - u0 >= math.sqrt(2 / m * self.posterior.variance(a) * max(d, 0)) + 2 / (3 * m) * max(d, 0)

    # --- a row ---

    def learn(self, x: np.ndarray, y: int) -> dict:
        o = self.o
        self.example += 1
        self.merges, self.deletions = [], []
        start = self.active
        active = self.states[self.active]
        self.flat.pop(start, None)
        self._observe(active, x, y)
        self._observe(self.background, x, y)
        if active.seen % o.fp_gap == 0:
            self._take_print(active)
        if self.background.seen % o.fp_gap == 0:
            self._take_print(self.background)
        if active.seen % o.na_fp_gap == 0 and (rows := self._stable(active)) is not None:
            for s, v in self._by_others(active, rows):
                if s.print is not None:
                    self._learn_range(v)
                    s.others.add(active.id, v)
                    self.own.pop(s.id, None)
                    self.stale = True
        similarity, likelihoods, priors, posteriors = None, {}, {}, {}
        drift = self.example in o.forced_drifts
        ready = len(active.window) >= self.min_rows and active.since >= self.min_rows
        if self.example % o.sim_gap == 0 and ready:
            v = self._describe(active, self._head(active))
            active.head = v
            similarity = self._distance(active, v)
            active.now = self._likelihood(active, similarity)
            if len(active.record) >= 2:
                drift |= self._watch(active.now)
            if len(self.background.window) >= self.min_rows:
                bg = self.background
                d = self._distance(bg, self._describe(bg, self._head(bg)))
                bg.now = self._likelihood(bg, d)
                if len(bg.record) >= 2 and self.bg_detector.fell(bg.now):
                    self._reset_background()
        if (drift or (o.ob_gap > 0 and self.example % o.ob_gap == 0)) and ready and active.print is not None:
            self._weigh(active)
            likelihoods = {s.id: s.now for s in self.states.values()}
            now = np.array(list(likelihoods.values()))
            self.likelihood.add(now)
            priors = self._priors(drift)
            raw = np.maximum(now, o.min_likelihood) * np.array(list(priors.values()))
            total = sum(raw.tolist())
            posteriors = dict(zip(likelihoods, (raw / total).tolist(), strict=True))
            self.posterior.add(raw / total)
            bg = self.background
            if len(bg.record) >= 2:
                bg.likelihood.add(bg.now)
                bg.posterior.add(bg.now * o.background_prior * priors[self.active] / total)
            if not active.stable and (active.seen > o.state_grace_windows * o.window_size or (self._mean_likelihood(active.id) >= o.bypass_grace_threshold and len(active.record) >= o.fingerprint_grace_period)):
                active.stable = True
            if o.merge:
                self._merge()
                active = self.states[self.active]
            if drift:
                self._at_drift(likelihoods, posteriors)
            else:
                self._continuous()
        if start == self.active:
            self._count("standard", start, start)
        return {
            "active_model": self.active, "change_detected": int(drift), "model_evolution": self.states[self.active].evolution, "similarity": similarity,
            "likelihoods": likelihoods, "priors": priors, "posteriors": posteriors, "merges": ";".join(self.merges) or None, "deletions": ";".join(self.deletions) or None,
        }

    def _by_others(self, active: State, rows: slice):
        """(state, description) of rows of the active window by all other states."""
        inactive = self._inactive()
        if inactive is not None:
            yield from zip(inactive.states, inactive.describe(rows, active.window, self.sources, self.kept), strict=True)
        else:
            for s in list(self.states.values()):
                if s.id != active.id:
                    yield s, self._describe(s, rows, active.window)

    def _weigh(self, active: State) -> None:
        """How likely the newest window is under each other state."""
        rows, inactive = self._head(active), self._inactive()
        if inactive is None:
            for s, v in self._by_others(active, rows):
                s.now = self._likelihood(s, self._distance(s, v))
        elif len(inactive.told):
            found = inactive.likelihoods(self, inactive.describe(rows, active.window, self.sources, self.kept))
            for s, now in zip(inactive.states, found, strict=True):
                s.now = now
        else:
            for s in inactive.states:
                s.now = 0.0

    def _mean_likelihood(self, id_: int) -> float:
        return float(self.likelihood.mean[list(self.states).index(id_)])

    def _at_drift(self, likelihoods: dict[int, float], posteriors: dict[int, float]) -> None:
        """The likeliest state that explains the window well enough, else a new one. Later ids win ties."""
        alive = [k for k in posteriors if k in self.states and (likelihoods[k] >= self.o.min_drift_likelihood)]
        if alive:
            best = max(alive, key=lambda k: (posteriors[k], k))
            if best != self.active:
                self._switch(self.states[best], True)
            else:
                self.detector.reset()
        else:
            self._switch(self._make(-1), True)

    def _continuous(self) -> None:
        """Leave the active state if another one, or the background model, is better by the bound."""
        o, active = self.o, self.states[self.active]
        states, bg = list(self.states.values()), self.background
        at, mean, likelihood = list(self.states).index(active.id), self.posterior.mean, self.likelihood.mean
        above = np.flatnonzero((mean > mean[at]) & (likelihood >= o.min_estimated_likelihood)).tolist()
        better = [i for i in above if states[i].print is not None and self._beats(at, i)]
        rejected = active.stable and self.likelihood.width[at] >= 5 and likelihood[at] < o.min_estimated_likelihood
        if better:
            self._switch(states[max(better, key=lambda i: (mean[i], states[i].id))], False)
        elif rejected and len(bg.record) >= 2 and bg.likelihood.mean > likelihood[at] and bg.seen >= o.window_size:
            self._switch(bg, False)


class FingerprintSystem(AdaptiveSystem):
    """Drift of the standardised distance only: no background model, priors or merges.

    At a drift the nearest state within `sim_stdevs` of its own record is taken, else a new one that first learns the
    newest rows.
    """

    def learn(self, x: np.ndarray, y: int) -> dict:
        o = self.o
        self.example += 1
        active = self.states[self.active]
        self._observe(active, x, y)
        if active.seen % o.fp_gap == 0:
            self._take_print(active)
        similarity, drift, likelihoods = None, self.example in o.forced_drifts, {}
        ready = active.since >= self.min_rows
        if self.example % o.sim_gap == 0 and ready and len(active.record) >= 2:
            similarity = self._distance(active, self._describe(active, self._head(active)))
            r = np.fromiter(active.record, float)
            sd = min(max(float(r.std(ddof=1)), o.min_sim_stdev), o.max_sim_stdev)
            drift |= self.detector.rose(1 + abs(similarity - float(r.mean())) / sd)
        if drift and ready:
            rows = self._head(active)
            fits = []
            for s in self.states.values():
                d = self._distance(s, self._describe(s, rows, active.window if s.id != active.id else None))
                likelihoods[s.id] = self._likelihood(s, d)
                if d is not None and len(s.record) >= 2:
                    r = np.fromiter(s.record, float)
                    sd = min(max(float(r.std(ddof=1)), o.min_sim_stdev), o.max_sim_stdev)
                    if abs(d - float(r.mean())) <= o.sim_stdevs * sd:
                        fits.append((likelihoods[s.id], s.id))
            if fits and max(fits)[1] != self.active:
                self._switch(self.states[max(fits)[1]], True)
            elif not fits:
                fresh = self._make(-1)
                n = len(active.window)
                newest = active.window.part(max(0, n - self.min_rows), n)
                for i in range(newest.stop - 1, newest.start - 1, -1):
                    fresh.tree.fit_one(active.window.x[i], int(active.window.y[i]), o.fit_weight)
                self._switch(fresh, True)
            else:
                self.detector.reset()
        return {
            "active_model": self.active, "change_detected": int(drift), "model_evolution": self.states[self.active].evolution, "similarity": similarity,
            "likelihoods": likelihoods, "priors": {}, "posteriors": {}, "merges": None, "deletions": None,
        }


class BoundSystem:
    """Reference systems that know the truth: `lower` one model, `middle` a new one at each true drift, `upper` one per concept."""

    def __init__(self, features: int, options: Options | None = None, kind: str = "lower"):
        if kind not in ("lower", "middle", "upper"):
            raise ValueError("kind must be lower, middle or upper")
        self.o, self.features, self.kind = options or Options(), features, kind
        self.trees: dict = {}
        self.key = self.last = None
        self.number = 0

    def at(self, concept) -> None:
        if concept is not None and concept != self.last:
            self.number += self.last is not None
            self.last = concept
        self.key = {"lower": 0, "middle": self.number, "upper": self.last}[self.kind]

    def _tree(self) -> HoeffdingTree:
        return self.trees.setdefault(self.key, HoeffdingTree(self.o.classes, self.features))

    def predict(self, x: np.ndarray) -> int:
        return self._tree().predict_one(x)

    def learn(self, x: np.ndarray, y: int) -> dict:
        t = self._tree()
        t.fit_one(x, y, self.o.fit_weight)
        return {"active_model": list(self.trees).index(self.key), "change_detected": 0, "model_evolution": t.evolution, "similarity": None, "likelihoods": {}, "priors": {}, "posteriors": {}, "merges": None, "deletions": None}


class EnsembleSystem:
    """Two ensembles of Hoeffding trees without concepts: `arf`, resampled trees that restart when ADWIN finds more errors;
    `dwm`, trees whose weight falls with errors and that are replaced."""

    def __init__(self, features: int, options: Options | None = None, kind: str = "arf", size: int = 10, seed: int = 1):
        self.o, self.features, self.kind, self.size = options or Options(), features, kind, size
        self.rng = np.random.default_rng(seed)
        self.trees = [self._tree() for _ in range(size if kind == "arf" else 1)]
        self.weights = [1.0] * len(self.trees)
        self.detectors = [Adwin(0.01) for _ in self.trees]
        self.example = 0

    def _tree(self) -> HoeffdingTree:
        return HoeffdingTree(self.o.classes, self.features)

    def predict(self, x: np.ndarray) -> int:
        votes = np.zeros(self.o.classes)
        for t, w in zip(self.trees, self.weights, strict=True):
            votes[t.predict_one(x)] += w
        return int(votes.argmax())

    def learn(self, x: np.ndarray, y: int) -> dict:
        self.example += 1
        guess = self.predict(x)
        changed = 0
        for i, t in enumerate(self.trees):
            wrong = t.predict_one(x) != y
            if self.kind == "arf":
                n = int(self.rng.poisson(self.o.fit_weight))
                if self.detectors[i].rose(float(wrong)):
                    self.trees[i], self.detectors[i], changed = self._tree(), Adwin(0.01), 1
                elif n:
                    t.fit_one(x, y, n)
            else:
                if wrong and self.example % 50 == 0:
                    self.weights[i] *= 0.5
                t.fit_one(x, y, 1)
        if self.kind == "dwm" and self.example % 50 == 0:
            top = max(self.weights)
            kept = [(t, w / top) for t, w in zip(self.trees, self.weights, strict=True) if w / top >= 0.01]
            if guess != y and len(kept) < self.size:
                kept.append((self._tree(), 1.0))
            self.trees, self.weights = [t for t, _ in kept], [w for _, w in kept]
        return {"active_model": 0, "change_detected": changed, "model_evolution": 1, "similarity": None, "likelihoods": {}, "priors": {}, "posteriors": {}, "merges": None, "deletions": None}


def make(name: str, features: int, options: Options):
    """A system by name; the names of ablations change the options."""
    from dataclasses import replace

    low = name.lower()
    if low == "cc":
        return AdaptiveSystem(features, options)
    if low == "cc_basicprior":
        return AdaptiveSystem(features, replace(options, background_prior=1.0, zero_prob=0.9999, multihop_penalty=0.0, prev_state_prior=0.0))
    if low == "cc_map":
        return AdaptiveSystem(features, replace(options, map_selection=True))
    if low == "cc_nomerge":
        return AdaptiveSystem(features, replace(options, merge=False))
    if low == "fingerprint":
        return FingerprintSystem(features, options)
    if low in ("lower_bound", "middle_bound", "upper_bound"):
        return BoundSystem(features, options, low.split("_")[0])
    if low in ("arf", "dwm"):
        return EnsembleSystem(features, options, low)
    raise ValueError(f"unknown system {name!r}")
