"""Aggregate expressions composed of built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_by_key(df: DataFrame, keys: Sequence[str], dependent: Sequence[str], *aggs: Column) -> DataFrame:
    """Group by a primary key and keep columns that depend on it."""
    return df.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in dependent], *aggs)


def array_agg(value: Column, order: Sequence[str] = ()) -> Column:
    """Array of a group's values with NULLs kept, sorted by ``order`` (``-`` is descending).

    One row holds the whole group: group by something with a bounded fan-out.
    """
    flags = [o.startswith("-") for o in order]
    fields = [F.col(o.lstrip("-")).alias(f"k{i}") for i, o in enumerate(order)]
    items = F.collect_list(F.struct(*fields, value.alias("v")))
    if not order:
        return F.transform(items, lambda s: s["v"])
    if any(flags) and not all(flags):

        def compare(a: Column, b: Column) -> Column:
            out = F.lit(0)
            for i, desc in reversed(list(enumerate(flags))):
                x, y = a[f"k{i}"], b[f"k{i}"]
                out = F.when(x < y, 1 if desc else -1).when(x > y, -1 if desc else 1).otherwise(out)
            return out

        return F.transform(F.array_sort(items, compare), lambda s: s["v"])
    return F.transform(F.sort_array(items, asc=not all(flags)), lambda s: s["v"])


def json_agg(value: Column, order: Sequence[str] = ()) -> Column:
    return F.to_json(array_agg(value, order), {"ignoreNullFields": "false"})


def json_object_agg(key: Column, value: Column) -> Column:
    """JSON object from key/value rows, keys sorted, NULL values and repeated keys kept; a NULL key is an error."""

    def text(v: Column) -> Column:
        whole = F.to_json(F.struct(v.alias("x")), {"ignoreNullFields": "false"})
        return F.substring(whole, F.lit(6), F.length(whole) - 6)

    name = F.coalesce(key.cast("string"), F.raise_error(F.lit("a key of a JSON object is NULL")).cast("string"))
    pair = F.concat(text(name), F.lit(":"), text(value))
    pairs = F.sort_array(F.collect_list(F.struct(key.alias("k"), value.alias("v"), pair.alias("t"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: p["t"]), ","), F.lit("}"))


def interval_micros(c: Column) -> Column:
    """Microseconds of a day-time interval, as a number wide enough to add up any number of them."""
    span = c.cast("interval day to second")
    part = lambda field, factor: (F.extract(F.lit(field), span) * F.lit(factor)).cast("long")
    micros = part("DAY", 86_400_000_000) + part("HOUR", 3_600_000_000) + part("MINUTE", 60_000_000) + part("SECOND", 1_000_000)
    return micros.cast("decimal(20,0)")


def interval_sum(c: Column) -> Column:
    """Sum of intervals in microseconds. An interval itself ends at 106,751,991 days, which a large group exceeds."""
    return F.sum(interval_micros(c))


def interval_avg(c: Column) -> Column:
    """Mean of intervals in microseconds, rounded."""
    return F.round(interval_sum(c) / F.nullif(F.count(c), F.lit(0)), 0)


def hypothetical(value: Column, arg: Column) -> dict[str, Column]:
    """Ranks that a row with ``arg`` would have among the group's values."""
    below, upto, n = F.count_if(value < arg), F.count_if(value <= arg), F.count(F.lit(1))
    return {
        "rank": below + 1,
        "dense_rank": F.count_distinct(F.when(value < arg, value)) + 1,
        "percent_rank": F.when(n == 0, F.lit(0.0)).otherwise(below / n),
        "cume_dist": (upto + 1) / (n + 1),
    }


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.ln(value)))


def least_of(*columns: str) -> Column:
    """Least value of several columns over the group."""
    return F.min(F.least(*columns) if len(columns) > 1 else F.col(columns[0]))
