"""Array-of-double vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """Unit length; a vector shorter than ``floor`` is divided by ``floor``."""
    vec = v.cast("array<double>")
    norm = F.greatest(l2_norm(vec), F.lit(floor))
    return F.transform(vec, lambda x: x / norm)
