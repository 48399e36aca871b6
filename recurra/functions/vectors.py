"""Distances and small vector algebra on array columns, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column, w: Column | None = None) -> Column:
    """Weighted inner product; weights enter each product once."""
    products = F.zip_with(a, b, lambda x, y: x * y)
    return _sum(products if w is None else F.zip_with(products, w, lambda p, v: p * v))


def cosine_distance(a: Column, b: Column, w: Column | None = None) -> Column:
    """1 - cosine; where a vector is zero: 0 if both are, else 1."""
    aa, bb = dot(a, a, w), dot(b, b, w)
    return F.when((aa > 0) & (bb > 0), 1 - dot(a, b, w) / F.sqrt(aa * bb)).when((aa == 0) & (bb == 0), 0.0).otherwise(1.0)


def euclidean_distance(a: Column, b: Column, w: Column | None = None) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, d, w))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Places where exactly one is non-zero, or both are and differ, over places where either is non-zero; 0 if none."""
    either = F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("double"))
    unlike = F.zip_with(a, b, lambda x, y: (((x != 0) | (y != 0)) & (x != y)).cast("double"))
    return F.when(_sum(either) > 0, _sum(unlike) / _sum(either)).otherwise(0.0)


def jmahal_distance(a: Column, b: Column, w: Column | None = None) -> Column:
    return jaccard_distance(a, b) + F.exp(cosine_distance(a, b, w))


def pearson_distance(a: Column, b: Column) -> Column:
    """1 - correlation of the elements; where a vector is constant: 0 if both are, else 1."""
    n = F.size(a).cast("double")
    ma, mb = _sum(a) / n, _sum(b) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    return cosine_distance(da, db)


def rescaled(v: Column, lo: Column, hi: Column) -> Column:
    """Min-max scaling of one value; 0.5 for a zero range or NaN, infinities to 0 and 1."""
    z = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.5)
    return F.when(v == float("inf"), 1.0).when(v == float("-inf"), 0.0).otherwise(F.nanvl(z, F.lit(0.5)))


def normal_tail(z: Column) -> Column:
    """Two-sided normal p-value of |z| by a rational approximation of the error function (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x * 0.3275911)
    # Coefficients of Abramowitz and Stegun 7.1.26.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def normal_cdf(z: Column) -> Column:
    half = normal_tail(z) / 2
    return F.when(z >= 0, 1 - half).otherwise(half)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def state_likelihood(distance: Column, mean: Column, stdev: Column, least: float = 0.015, most: float = 0.175) -> Column:
    """Two-sided p-value of a distance under a normal whose stdev is clamped; 0 without a record."""
    scale = F.least(F.greatest(stdev, F.lit(least)), F.lit(most))
    return F.coalesce(normal_tail((distance - mean) / scale), F.lit(0.0))
