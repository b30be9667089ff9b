"""Scalar functions of the workload model, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def recency(age_days: Column, half_life_days: float) -> Column:
    return F.pow(F.lit(2.0), -age_days / F.lit(float(half_life_days)))


def saturation(x: Column, half: Column | float) -> Column:
    half = half if isinstance(half, Column) else F.lit(float(half))
    return x / (x + half)


def uniform(seed: int, stream: str, *keys: Column) -> Column:
    """A number in [0, 1) for each row, from a hash: the same on any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), *keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pick(u: Column, weights: list[float]) -> Column:
    """Index drawn by inverse distribution from ``u``."""
    total, bound, out = sum(weights), 0.0, None
    for i, w in enumerate(weights[:-1]):
        bound += w / total
        out = F.when(u < bound, i) if out is None else out.when(u < bound, i)
    return out.otherwise(len(weights) - 1) if out is not None else F.lit(0)


def normal(u: Column, v: Column) -> Column:
    """A standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def inclusion(weight: Column, total_weight: Column, wanted: Column) -> Column:
    """Chance that a row is drawn so that ``wanted`` are expected."""
    return F.least(F.greatest(weight * wanted / total_weight, F.lit(0.0)), F.lit(1.0))
