"""Text-to-text maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def get(h: Column, key: str) -> Column:
    return F.try_element_at(h, F.lit(key))


def exist(h: Column, key: str) -> Column:
    return F.map_contains_key(h, key)


def defined(h: Column, key: str) -> Column:
    """Key present with a value that is not NULL."""
    return get(h, key).isNotNull()


def exist_any(h: Column, keys: Sequence[str]) -> Column:
    return F.arrays_overlap(F.map_keys(h), F.array(*[F.lit(k) for k in keys]))


def exist_all(h: Column, keys: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), F.map_keys(h))) == 0


def slice(h: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(h, lambda k, v: k.isin(*keys))


def concat(a: Column, b: Column) -> Column:
    """Union in which the right side wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def delete(h: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(h, lambda k, v: ~k.isin(*keys))


def contains(h: Column, part: Column) -> Column:
    """Every pair of ``part`` is in ``h``."""
    return F.forall(F.map_entries(part), lambda e: F.map_contains_key(h, e["key"]) & F.try_element_at(h, e["key"]).eqNullSafe(e["value"]))


def to_array(h: Column) -> Column:
    """Keys and values in turn."""
    return F.flatten(F.transform(F.array_sort(F.map_entries(h)), lambda e: F.array(e["key"], e["value"])))


def text(h: Column) -> Column:
    """``k=v`` pairs, keys sorted."""
    pairs = F.array_sort(F.map_entries(h))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ",")
