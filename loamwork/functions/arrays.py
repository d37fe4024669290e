"""Expressions over arrays that take time in proportion to their size, or little more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where lambdas of ``body`` use it at every step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each element of an array of longs, ``step`` folded over the elements up to it, from ``zero``; ``step`` is associative.

    The array is folded in parts of about the square root of its size, as an append copies what is there: time is the
    1.5th power of the size, not its square.
    """
    none = F.array().cast("array<long>")
    fold = lambda part: F.aggregate(part, none, lambda acc, x: F.array_append(acc, step(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x)))

    def parts(v: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), size), lambda k: fold(F.slice(v, k + 1, size)))

    def put_together(folded: Column) -> Column:
        ends = fold(F.transform(folded, lambda part: F.coalesce(F.get(part, F.size(part) - 1), zero)))
        before = F.concat(F.array(zero), ends)
        return F.flatten(F.zip_with(folded, F.slice(before, 1, F.size(folded)), lambda part, b: F.transform(part, lambda x: step(b, x))))

    return bound(values.cast("array<long>"), lambda v: bound(parts(v), put_together))
