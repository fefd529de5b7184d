"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Scaled to length 1; null for a zero vector."""
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))


def problems(a: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """What disqualifies a vector for an index: array of names, empty when sound."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.array_compact(
        F.array(
            F.when(a.isNull() | (F.size(a) != dim), F.lit("dimension")),
            F.when(bad, F.lit("not finite")),
            F.when(~bad & (F.abs(norm(a) - 1) > tolerance), F.lit("norm")),
        )
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
