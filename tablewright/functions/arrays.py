"""Array functions; arrays count from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.expressions import parse


def position(a: Column, v: Column, start: int = 1) -> Column:
    """First index of a value at or after ``start``; NULL when absent."""
    hits = F.filter(positions(a, v), lambda i: i >= start)
    return F.get(hits, F.lit(0))


def positions(a: Column, v: Column) -> Column:
    """All indexes of a value; NULL is found as well."""
    n = F.size(a)
    index = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(index, lambda i: F.get(a, i - 1).eqNullSafe(v))


def replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda x: F.when(x.eqNullSafe(old), new).otherwise(x))


def fill(v: Column, *dims: int) -> Column:
    """Array of one value with the given dimensions."""
    out = v
    for n in reversed(dims):
        out = F.array_repeat(out, n)
    return out


def contains(a: Column, b: Column) -> Column:
    """Does ``a`` hold every element of ``b``? A NULL element is never held."""
    return F.forall(b, lambda x: F.coalesce(F.array_contains(a, x), F.lit(False)))


def overlaps(a: Column, b: Column) -> Column:
    """Any common element; NULL elements match nothing."""
    return F.arrays_overlap(F.array_compact(a), F.array_compact(b))


def subscript(a: Column, i: Column) -> Column:
    """Element ``i``, NULL outside the array."""
    return F.when(i >= 1, F.get(a, i - 1))


def part(a: Column, low: Column, high: Column) -> Column:
    """Elements ``low`` to ``high``, cut to the array."""
    lo, hi = F.greatest(low, F.lit(1)), F.least(high, F.size(a))
    return F.slice(a, lo, F.greatest(hi - lo + 1, F.lit(0)))


def assign(a: Column, i: int, v: Column) -> Column:
    """Array with element ``i`` set; NULLs fill the gap beyond its end."""
    n = F.greatest(F.size(a), F.lit(i))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == i, v).otherwise(F.get(a, k - 1)))


def dims_text(*levels: Column) -> Column:
    """``[1:2][1:3]`` for the sizes of each level."""
    return F.concat(*[F.concat(F.lit("[1:"), n.cast("string"), F.lit("]")) for n in levels])


def to_array(c: Column, delimiter: str, null: str | None = None) -> Column:
    """Split text; parts equal to ``null`` become NULL."""
    parts = F.split(c, re.escape(delimiter))
    return parts if null is None else F.transform(parts, lambda x: F.nullif(x, F.lit(null)))


def uniq(a: Column) -> Column:
    """Drop adjacent repeats."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def subarray(a: Column, start: int, length: int | None = None) -> Column:
    """Slice where a negative start counts from the end and a negative length drops from it."""
    n = F.size(a)
    first = F.lit(start) if start > 0 else F.greatest(n + start + 1, F.lit(1)) if start < 0 else F.lit(1)
    if length is None:
        last = n
    else:
        last = first + length - 1 if length >= 0 else n + length
    return part(a, first, last)


def push_all(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def without(a: Column, b: Column) -> Column:
    """Sorted distinct elements of ``a`` not in ``b``."""
    return F.sort_array(F.array_except(a, b))


def union_sorted(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(a, b))


def intersect_sorted(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def boolean_query(text: str, leaf) -> Column:
    """Column of a small boolean expression with ``& | ! ( )`` over leaf words."""
    out = parse(text, leaf, lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    if out is None:
        raise ValueError("an empty expression")
    return out


def matches_query(a: Column, query: str) -> Column:
    """``arr @@ '1&(2|3)'`` for an array of numbers."""
    return boolean_query(query, lambda word: F.array_contains(a, F.lit(int(word))))
