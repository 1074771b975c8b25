"""Numeric, bit-string and money functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.functions.core import bound


def trunc(c: Column) -> Column:
    """Drop the fraction."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def round_half_even(c: Column) -> Column:
    return F.rint(c)


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, cut towards zero."""
    return F.call_function("div", a, b)


def _exact(value: Column, degrees: Column, table: dict[int, float]) -> Column:
    out = value
    for angle, exact in table.items():
        out = F.when(degrees == angle, F.lit(exact)).otherwise(out)
    return out


# Angles in degrees whose functions are exact.
SIN_TABLE = {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}
COS_TABLE = {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}
TAN_TABLE = {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0}


def sind(c: Column) -> Column:
    return _exact(F.sin(F.radians(c)), F.pmod(c, F.lit(360)), SIN_TABLE)


def cosd(c: Column) -> Column:
    return _exact(F.cos(F.radians(c)), F.pmod(c, F.lit(360)), COS_TABLE)


def tand(c: Column) -> Column:
    d = F.pmod(c, F.lit(360))
    out = _exact(F.tan(F.radians(c)), d, TAN_TABLE)
    return F.when(d == 90, F.lit(float("inf"))).when(d == 270, F.lit(float("-inf"))).otherwise(out)


def cotd(c: Column) -> Column:
    return tand(F.lit(90) - c)


# Exact results of the inverse functions in degrees.
ASIN_TABLE = {0.0: 0.0, 0.5: 30.0, 1.0: 90.0, -0.5: -30.0, -1.0: -90.0}
ACOS_TABLE = {1.0: 0.0, 0.5: 60.0, 0.0: 90.0, -0.5: 120.0, -1.0: 180.0}
ATAN_TABLE = {0.0: 0.0, 1.0: 45.0, -1.0: -45.0}


def asind(c: Column) -> Column:
    return _exact(F.degrees(F.asin(c)), c, ASIN_TABLE)


def acosd(c: Column) -> Column:
    return _exact(F.degrees(F.acos(c)), c, ACOS_TABLE)


def atand(c: Column) -> Column:
    return _exact(F.degrees(F.atan(c)), c, ATAN_TABLE)


def atan2d(y: Column, x: Column) -> Column:
    base = F.degrees(F.atan2(y, x))
    return F.when((F.abs(x) == F.abs(y)) & (x != 0), F.rint(base)).otherwise(base)


def width_bucket_array(c: Column, thresholds: Column) -> Column:
    """Number of sorted thresholds at or below the value."""
    return F.size(F.filter(thresholds, lambda t: t <= c))


# -- bit strings: text of 0 and 1 --------------------------------------------


def bits_from_int(c: Column, n: int) -> Column:
    """Lowest ``n`` bits of an integer."""
    return F.right(F.lpad(F.bin(c.cast("long")), max(n, 64), "0"), F.lit(n))


def bits_to_int(bits: Column) -> Column:
    return F.conv(bits, 2, 10).cast("long")


def bits_zip(a: Column, b: Column, rule: str) -> Column:
    """``and``, ``or`` or ``xor`` of two bit strings of one length, of any length."""
    one = {
        "and": lambda x, y: F.when((x == "1") & (y == "1"), "1").otherwise("0"),
        "or": lambda x, y: F.when((x == "1") | (y == "1"), "1").otherwise("0"),
        "xor": lambda x, y: F.when(x == y, "0").otherwise("1"),
    }[rule]
    return F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), one), "")


def bits_not(a: Column) -> Column:
    return F.translate(a, "01", "10")


def bits_shift(a: Column, n: int) -> Column:
    """Shift left by ``n`` (right when negative); the length stays."""
    size = F.length(a)
    k = abs(n)
    if n >= 0:
        return F.rpad(F.substring(a, F.lit(k + 1), size), size, "0")
    return F.lpad(F.substring(a, F.lit(1), F.greatest(size - k, F.lit(0))), size, "0")


def get_bit(a: Column, n: int) -> Column:
    """Bit ``n`` counted from the left, from 0."""
    return F.substring(a, n + 1, 1).cast("int")


def set_bit(a: Column, n: int, value: int) -> Column:
    return F.overlay(a, F.lit(str(value)), F.lit(n + 1), F.lit(1))


# -- money ---------------------------------------------------------------------


def money(c: Column) -> Column:
    """Currency with two decimals, halves away from zero."""
    return F.round(c.cast("decimal(30,6)"), 2).cast("decimal(19,2)")


def _cents(m: Column) -> Column:
    return F.round(m.cast("decimal(21,2)") * 100).cast("long")


def _from_cents(c: Column) -> Column:
    return (c.cast("decimal(19,0)") / 100).cast("decimal(19,2)")


def money_times(m: Column, factor: Column) -> Column:
    """Product with a float, to the nearest cent, halves to even."""
    return _from_cents(F.rint(_cents(m) * factor.cast("double")))


def money_over(m: Column, divisor: Column) -> Column:
    """Quotient by a float, to the nearest cent, halves to even."""
    return _from_cents(F.rint(_cents(m) / divisor.cast("double")))


def money_over_int(m: Column, divisor: Column) -> Column:
    """Quotient by an integer, cut towards zero."""
    return _from_cents(int_div(_cents(m), divisor.cast("long")))


def money_text(m: Column) -> Column:
    """``$1,234.50``; negative values carry the sign in front."""
    return F.concat(F.when(m < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(m), 2))


# English number words.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = (("quadrillion", 10**15), ("trillion", 10**12), ("billion", 10**9), ("million", 10**6), ("thousand", 1000), ("", 1))


def _word(table: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in table]), index.cast("int"))


def _below_hundred(n: Column) -> Column:
    ten, one = F.floor(n / 10), n % 10
    return (
        F.when(n < 20, _word(ONES, n))
        .when(one == 0, _word(TENS, ten))
        .otherwise(F.concat(_word(TENS, ten), F.lit(" "), _word(ONES, one)))
    )


@bound
def _below_thousand(n: Column) -> Column:
    hundred, rest = F.floor(n / 100), n % 100
    head = F.concat(_word(ONES, hundred), F.lit(" hundred"))
    link = F.when(rest < 20, F.lit(" and ")).otherwise(F.lit(" "))
    return F.when(hundred == 0, _below_hundred(rest)).when(rest == 0, head).otherwise(F.concat(head, link, _below_hundred(rest)))


@bound
def cash_words(m: Column) -> Column:
    """Amount in words, such as ``Twelve dollars and five cents``.

    A scale word keeps its trailing blank even when nothing follows it.
    """
    cents_total = F.abs(F.round(m.cast("decimal(21,2)") * 100).cast("long"))
    whole, cents = F.floor(cents_total / 100).cast("long"), cents_total % 100
    groups = []
    for name, size in SCALES:
        part = F.floor(whole / size).cast("long") % 1000
        text = F.concat(_below_thousand(part), F.lit(f" {name} ")) if name else _below_thousand(part)
        groups.append(F.when(part > 0, text))
    spoken = F.when(whole == 0, F.lit("zero")).otherwise(F.concat_ws("", *groups))
    text = F.concat(
        F.when(m < 0, F.lit("minus ")).otherwise(F.lit("")), spoken, F.when(whole == 1, F.lit(" dollar and ")).otherwise(F.lit(" dollars and ")),
        _below_hundred(cents), F.when(cents == 1, F.lit(" cent")).otherwise(F.lit(" cents")),
    )
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
