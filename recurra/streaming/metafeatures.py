"""Meta-features of windows in numpy: what the stateful systems and grouped functions compute per window."""

from __future__ import annotations

import math

import numpy as np

FEATURES = ("FI", "IMF_0", "IMF_1", "IMF_2", "MI", "acf_1", "acf_2", "kurtosis", "mean", "pacf_1", "pacf_2", "skew", "stdev", "turning_point_rate")
DEFAULT_IGNORE = ("IMF_0", "IMF_1", "IMF_2", "MI", "pacf_1", "pacf_2")


def basic(x: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each column of x (rows x series), by the incremental rules for degenerate windows."""
    n, s = x.shape
    zero = np.zeros(s)
    if n < 1:
        return {k: zero for k in ("mean", "stdev", "skew", "turning_point_rate", "acf_1", "acf_2", "pacf_1", "pacf_2")} | {"kurtosis": zero - 3}
    total = np.add.reduce
    m = total(x, 0) / n
    d = x - m
    d2 = d * d
    squares = total(d2, 0)
    c0 = squares / n
    ok = (c0 > 1e-14) & (n > 1)
    safe = np.where(ok, c0, 1.0)
    out = {
        "mean": m,
        "stdev": np.sqrt(squares / (n - 1)) if n > 1 else zero,
        "skew": np.where(ok, total(d2 * d, 0) / n / safe**1.5, 0.0),
        "kurtosis": np.where(ok, total(d2 * d2, 0) / n / safe**2 - 3, -3.0),
    }
    step = x[1:] - x[:-1]
    out["turning_point_rate"] = (step[1:] * step[:-1] < 0).sum(0) / n if n > 2 else zero
    r = {}
    for k in (1, 2):
        r[k] = np.where(ok, total(d[k:] * d[:-k], 0) / n / safe, 0.0) if n > k else zero
        out[f"acf_{k}"] = r[k]
    u1 = r[1] * n / (n - 1) if n > 1 else zero
    u2 = r[2] * n / (n - 2) if n > 2 else zero
    left = 1 - u1 * u1
    out["pacf_1"] = u1
    out["pacf_2"] = np.where(np.abs(left) > 1e-12, (u2 - u1 * u1) / np.where(np.abs(left) > 1e-12, left, 1), 0.0) if n > 2 else zero
    return out


def _digamma(x: np.ndarray | float) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def knn_mi(a: np.ndarray, b: np.ndarray, k: int = 3, seed: int = 42) -> float:
    """Mutual information of two samples by nearest neighbours (Kraskov et al., 2004), in nats, at least 0."""
    n = len(a)
    if n <= k + 1:
        return 0.0
    rng = np.random.default_rng(seed)

    def prepared(v):
        v = np.asarray(v, float)
        sd = v.std()
        v = v / sd if sd > 0 else v
        return v + 1e-10 * max(1.0, np.abs(v).mean()) * rng.standard_normal(n)

    a, b = prepared(a), prepared(b)
    da, db = np.abs(a[:, None] - a), np.abs(b[:, None] - b)
    both = np.maximum(da, db)
    np.fill_diagonal(both, np.inf)
    radius = np.nextafter(np.partition(both, k - 1, axis=1)[:, k - 1], 0)
    na = (da <= radius[:, None]).sum(1)
    nb = (db <= radius[:, None]).sum(1)
    return float(max(0.0, _digamma(n) + _digamma(k) - _digamma(na).mean() - _digamma(nb).mean()))


def auto_mi(x: np.ndarray) -> float:
    """Mutual information of a series and itself one step later; 0 up to four values."""
    return knn_mi(x[:-1], x[1:]) if len(x) > 4 else 0.0


def permutation_entropy(x: np.ndarray, size: int = 3) -> float:
    """Bits of the distribution of ordinal patterns (Bandt and Pompe, 2002)."""
    if len(x) < size:
        return 0.0
    windows = np.lib.stride_tricks.sliding_window_view(x, size)
    ranks = np.argsort(windows, axis=1, kind="stable") @ (size ** np.arange(size))
    p = np.unique(ranks, return_counts=True)[1] / len(windows)
    return float(-(p * np.log2(p)).sum())


def emd(x: np.ndarray, most: int = 2, sifts: int = 20) -> list[np.ndarray]:
    """Empirical mode decomposition with linear envelopes (Huang et al., 1998): up to `most` modes, then the rest."""
    rest, out, at = x.astype(float), [], np.arange(len(x))
    for _ in range(most):
        mode = rest.copy()
        for _ in range(sifts):
            d = np.diff(mode)
            top = np.flatnonzero((d[:-1] > 0) & (d[1:] <= 0)) + 1
            low = np.flatnonzero((d[:-1] < 0) & (d[1:] >= 0)) + 1
            if len(top) < 2 or len(low) < 2:
                break
            mean = (np.interp(at, top, mode[top]) + np.interp(at, low, mode[low])) / 2
            mode -= mean
            if (mean * mean).sum() < 1e-3 * (mode * mode).sum():
                break
        else:
            pass
        if np.allclose(mode, rest) and out:
            break
        out.append(mode)
        rest = rest - mode
    return [*out, rest]


def imf_entropies(x: np.ndarray) -> list[float]:
    """Permutation entropies of two modes and the rest; missing ones are 0."""
    parts = emd(x) if len(x) > 3 else []
    e = [permutation_entropy(p) for p in parts][:3]
    return e + [0.0] * (3 - len(e))


def describe(series: list[np.ndarray], importance: np.ndarray, ignore: tuple[str, ...] = DEFAULT_IGNORE) -> np.ndarray:
    """Flat vector of all kept features of each series, series first, features in order of name.

    Series may differ in length; those of one length are computed together. importance: FI of each series.
    """
    keep = [f for f in FEATURES if f not in ignore]
    out = np.zeros((len(series), len(keep)))
    by_len: dict[int, list[int]] = {}
    for i, s in enumerate(series):
        by_len.setdefault(len(s), []).append(i)
    for ids in by_len.values():
        stats = basic(np.stack([series[i] for i in ids], axis=1))
        for j, f in enumerate(keep):
            if f in stats:
                out[ids, j] = stats[f]
    for j, f in enumerate(keep):
        if f == "FI":
            out[:, j] = importance
        elif f == "MI":
            out[:, j] = [auto_mi(s) for s in series]
        elif f.startswith("IMF"):
            out[:, j] = [imf_entropies(s)[int(f[-1])] for s in series]
    return out.ravel()


def error_gaps(correct: np.ndarray) -> np.ndarray:
    """Rows between successive errors."""
    return np.diff(np.flatnonzero(correct == 0)).astype(float)


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))
