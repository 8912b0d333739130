"""Statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of the Wilson score interval, within [0, 1]; (0, 0) for n = 0."""
    p = k / n
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = n > 0
    low = F.when(ok, F.greatest(F.lit(0.0), mid - half)).otherwise(F.lit(0.0))
    high = F.when(ok, F.least(F.lit(1.0), mid + half)).otherwise(F.lit(0.0))
    return F.struct(low.alias("low"), high.alias("high"))


def cohens_d(mean_a: Column, var_a: Column, n_a: Column, mean_b: Column, var_b: Column, n_b: Column) -> Column:
    """From means, sample variances and counts; 0 if a group is empty or nothing varies."""
    pooled = F.sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2))
    return F.when((n_a > 0) & (n_b > 0) & (n_a + n_b > 2) & (pooled > 0), (mean_a - mean_b) / pooled).otherwise(F.lit(0.0))


def bin_of(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal bins from 0, the last closed on the right; all in bin 0 where the range is a point."""
    return F.when(high > low, F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")


def percentile_rank(p: float, n: Column) -> Column:
    """1-based place of the percentile that is sorted[min(n - 1, int(p n))]; neither percentile nor percentile_disc."""
    return F.least(n, F.floor(F.lit(p) * n) + 1)


def keep_count(n: int, fraction: float) -> int:
    """max(1, n * fraction rounded half to even)."""
    return max(1, round(n * fraction)) if n else 0


def idf(df: Column, n: int | Column) -> Column:
    return F.log((1 + F.lit(n) if isinstance(n, int) else 1 + n) / (1 + df)) + 1


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays; 0 if one has norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def lane_coefficients(k: int, seed: int = 7, prime: int = (1 << 31) - 1) -> tuple[list[int], list[int]]:
    """MinHash coefficients from the seeded generator."""
    import numpy as np

    rng = np.random.RandomState(seed)
    return rng.randint(1, prime, size=k).tolist(), rng.randint(0, prime, size=k).tolist()


def misses(j: float, bands: int, rows: int) -> float:
    """Chance that LSH banding misses a pair of this likeness."""
    return (1 - j**rows) ** bands if 0 <= j <= 1 else math.nan
