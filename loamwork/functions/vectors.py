"""Expressions on probability vectors (arrays of doubles in a fixed label order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12
#: What the sum of a vector that was brought to sum one is off by, at most.
ROUNDING = 1e-14


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a + x)


def valid(p: Column, size: int, tolerance: float = 2e-5) -> Column:
    """Finite, inside [0, 1] and summing to one."""
    inside = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= -1e-8) & (x <= 1 + 1e-8))
    return F.coalesce((F.size(p) == size) & inside & (F.abs(total(p) - 1) <= tolerance), F.lit(False))


def normalised(p: Column) -> Column:
    """Clipped from below and brought to sum one; a vector that is so but for rounding stays, as a bin's border may lie at it."""
    clipped = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1.0)))
    return F.when(F.abs(total(clipped) - 1) <= ROUNDING, clipped).otherwise(F.transform(clipped, lambda x: x / total(clipped)))


def checked(p: Column, size: int) -> Column:
    return F.when(valid(p, size), normalised(p)).otherwise(F.raise_error(F.lit("invalid probability vector")))


def argmax(p: Column, labels: Sequence[str]) -> Column:
    """Label of the greatest entry, the first on ties."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.ln(F.greatest(x, F.lit(FLOOR))))


def margin(p: Column) -> Column:
    ordered = F.sort_array(p, False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def judgeability(p: Column) -> Column:
    return F.get(p, F.lit(0)) + F.get(p, F.lit(1))


def support_given_judgeable(p: Column) -> Column:
    return F.get(p, F.lit(0)) / F.greatest(judgeability(p), F.lit(FLOOR))


def l1(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x)


def softmax(x: Column) -> Column:
    shifted = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(shifted, lambda v: v / total(shifted))


def tempered(p: Column, temperature: Column | float) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    return softmax(F.transform(p, lambda x: F.ln(F.greatest(x, F.lit(FLOOR))) / t))


def mean_of(vectors: Column) -> Column:
    """Elementwise mean of an array of vectors."""
    n = F.size(vectors)
    first = F.get(vectors, F.lit(0))
    return F.transform(first, lambda _, i: F.aggregate(vectors, F.lit(0.0), lambda a, v: a + F.get(v, i)) / n)


def blended(vectors: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of vectors of one size."""
    scale = sum(weights)
    first = vectors[0]
    return F.transform(first, lambda _, i: sum((F.get(v, i) * w for v, w in zip(vectors[1:], weights[1:], strict=True)), F.get(first, i) * weights[0]) / scale)


def stage_view(p: Column) -> Column:
    """(support if judgeable, insufficient, error) of a four-label vector."""
    return F.array(support_given_judgeable(p), F.get(p, F.lit(2)), F.get(p, F.lit(3)))
