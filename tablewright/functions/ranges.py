"""Ranges: ``struct<lower, upper, lower_inc, upper_inc, empty>``; a NULL bound is infinite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.core import bound


def make(lower: Column, upper: Column, bounds: str = "[)", step: Column | None = None) -> Column:
    """Range with bounds ``[) [] (] ()``. ``step`` gives a discrete type the canonical
    form ``[)``; a lower bound above the upper one is an error."""
    lo_inc, hi_inc = bounds[0] == "[", bounds[1] == "]"
    wrong = F.raise_error(F.lit("range lower bound must be less than or equal to range upper bound"))
    lower = F.when(lower > upper, wrong).otherwise(lower)
    lo, hi = lower, upper
    lo_flag, hi_flag = F.lit(lo_inc), F.lit(hi_inc)
    if step is not None:
        lo = lo if lo_inc else lo + step
        hi = hi + step if hi_inc else hi
        lo_flag, hi_flag = F.lit(True), F.lit(False)
    return _canon(lo, hi, lo_flag & lo.isNotNull(), hi_flag & hi.isNotNull())


def _canon(lo: Column, hi: Column, lo_inc: Column, hi_inc: Column, empty: Column | None = None) -> Column:
    void = F.coalesce((lo > hi) | ((lo == hi) & ~(lo_inc & hi_inc)), F.lit(False))
    if empty is not None:
        void = void | empty
    none = lambda c: F.when(~void, c)
    return F.struct(
        none(lo).alias("lower"), none(hi).alias("upper"), (lo_inc & lo.isNotNull() & ~void).alias("lower_inc"),
        (hi_inc & hi.isNotNull() & ~void).alias("upper_inc"), void.alias("empty"),
    )


def lower(r: Column) -> Column:
    return r["lower"]


def upper(r: Column) -> Column:
    return r["upper"]


def is_empty(r: Column) -> Column:
    return r["empty"]


def lower_inf(r: Column) -> Column:
    return ~r["empty"] & r["lower"].isNull()


def upper_inf(r: Column) -> Column:
    return ~r["empty"] & r["upper"].isNull()


def _starts_before_or_at(a: Column, b: Column) -> Column:
    """Lower bound of ``a`` is at or before that of ``b``."""
    return a["lower"].isNull() | (b["lower"].isNotNull() & (
        (a["lower"] < b["lower"]) | ((a["lower"] == b["lower"]) & (a["lower_inc"] | ~b["lower_inc"]))
    ))


def _ends_after_or_at(a: Column, b: Column) -> Column:
    return a["upper"].isNull() | (b["upper"].isNotNull() & (
        (a["upper"] > b["upper"]) | ((a["upper"] == b["upper"]) & (a["upper_inc"] | ~b["upper_inc"]))
    ))


def contains_element(r: Column, x: Column) -> Column:
    above = r["lower"].isNull() | (x > r["lower"]) | ((x == r["lower"]) & r["lower_inc"])
    below = r["upper"].isNull() | (x < r["upper"]) | ((x == r["upper"]) & r["upper_inc"])
    return ~r["empty"] & above & below


def contains(a: Column, b: Column) -> Column:
    return b["empty"] | (~a["empty"] & _starts_before_or_at(a, b) & _ends_after_or_at(a, b))


def contained_by(a: Column, b: Column) -> Column:
    return contains(b, a)


def left_of(a: Column, b: Column) -> Column:
    """All of ``a`` lies before all of ``b``."""
    apart = (a["upper"] < b["lower"]) | ((a["upper"] == b["lower"]) & ~(a["upper_inc"] & b["lower_inc"]))
    return ~a["empty"] & ~b["empty"] & F.coalesce(apart, F.lit(False))


def right_of(a: Column, b: Column) -> Column:
    return left_of(b, a)


def overlaps(a: Column, b: Column) -> Column:
    return ~a["empty"] & ~b["empty"] & ~left_of(a, b) & ~left_of(b, a)


def not_right_of(a: Column, b: Column) -> Column:
    """``&<``: ``a`` does not extend beyond the upper end of ``b``."""
    return ~a["empty"] & ~b["empty"] & _ends_after_or_at(b, a)


def not_left_of(a: Column, b: Column) -> Column:
    """``&>``: ``a`` does not extend below the lower end of ``b``."""
    return ~a["empty"] & ~b["empty"] & _starts_before_or_at(b, a)


def adjacent(a: Column, b: Column) -> Column:
    def touch(x: Column, y: Column) -> Column:
        return F.coalesce((x["upper"] == y["lower"]) & (x["upper_inc"] != y["lower_inc"]), F.lit(False))

    return ~a["empty"] & ~b["empty"] & (touch(a, b) | touch(b, a))


def _pick(test: Column, a: Column, b: Column, bound: str) -> tuple[Column, Column]:
    return (
        F.when(test, a[bound]).otherwise(b[bound]), F.when(test, a[f"{bound}_inc"]).otherwise(b[f"{bound}_inc"]),
    )


@bound
def merge(a: Column, b: Column) -> Column:
    """Smallest range that holds both."""
    lo, li = _pick(_starts_before_or_at(a, b), a, b, "lower")
    hi, ui = _pick(_ends_after_or_at(a, b), a, b, "upper")
    return F.when(a["empty"], b).when(b["empty"], a).otherwise(_canon(lo, hi, li, ui))


@bound
def union(a: Column, b: Column) -> Column:
    """Union; an error when a gap lies between."""
    joined = a["empty"] | b["empty"] | overlaps(a, b) | adjacent(a, b)
    return F.when(joined, merge(a, b)).otherwise(F.raise_error(F.lit("result of range union would not be contiguous")))


@bound
def intersect(a: Column, b: Column) -> Column:
    lo, li = _pick(_starts_before_or_at(a, b), b, a, "lower")
    hi, ui = _pick(_ends_after_or_at(a, b), b, a, "upper")
    return _canon(lo, hi, li, ui, ~overlaps(a, b))


@bound
def minus(a: Column, b: Column) -> Column:
    """Difference; an error when it would fall in two."""
    head = ~_starts_before_or_at(b, a)  # part of a before b
    tail = ~_ends_after_or_at(b, a)
    left = _canon(a["lower"], b["lower"], a["lower_inc"], ~b["lower_inc"])
    right = _canon(b["upper"], a["upper"], ~b["upper_inc"], a["upper_inc"])
    void = _canon(a["lower"], a["upper"], a["lower_inc"], a["upper_inc"], F.lit(True))
    return (
        F.when(~overlaps(a, b), a)
        .when(head & tail, F.raise_error(F.lit("result of range difference would not be contiguous")))
        .when(head, left).when(tail, right).otherwise(void)
    )


def sort_key(r: Column) -> Column:
    """Order: empty first, then lower bound (infinite first), then upper (infinite last)."""
    return F.struct(
        (~r["empty"]).alias("a"), r["lower"].isNotNull().alias("b"), r["lower"].alias("c"), (~r["lower_inc"]).alias("d"),
        (r["upper"].isNull() & ~r["empty"]).alias("e"), r["upper"].alias("f"), r["upper_inc"].alias("g"),
    )


def length(r: Column) -> Column:
    return r["upper"] - r["lower"]


@bound
def text(r: Column) -> Column:
    """``[1,5)``, with nothing at an infinite bound, or ``empty``."""
    show = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.when(r["empty"], F.lit("empty")).otherwise(
        F.concat(
            F.when(r["lower_inc"], "[").otherwise("("), show(r["lower"]), F.lit(","), show(r["upper"]), F.when(r["upper_inc"], "]").otherwise(")")
        )
    )
