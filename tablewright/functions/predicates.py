"""Predicates of three-valued logic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_true(c: Column) -> Column:
    return c.eqNullSafe(True)


def is_not_true(c: Column) -> Column:
    return ~c.eqNullSafe(True)


def is_false(c: Column) -> Column:
    return c.eqNullSafe(False)


def is_unknown(c: Column) -> Column:
    return c.isNull()


def is_distinct_from(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def num_nulls(*cols: Column) -> Column:
    return sum((c.isNull().cast("int") for c in cols), F.lit(0))


def num_nonnulls(*cols: Column) -> Column:
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def between_symmetric(c: Column, a: Column, b: Column) -> Column:
    """Range test whose bounds may come in either order; NULL if a bound is NULL."""
    known = a.isNotNull() & b.isNotNull()
    return F.when(known, c.between(F.least(a, b), F.greatest(a, b)))


def any_of(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(array, test)


def all_of(array: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(array, test)
