"""Rows to columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ordered


def crosstab_by_category(df: DataFrame, row: str, category: str, value: str, categories: Sequence) -> DataFrame:
    """One column per listed category; missing ones are NULL, unlisted ones are dropped."""
    return df.groupBy(row).pivot(category, list(categories)).agg(F.first(value, ignorenulls=True))


def crosstab_by_position(df: DataFrame, row: str, order: Sequence[str], value: str, width: int) -> DataFrame:
    """First ``width`` values of each row name, left to right, in ``order``."""
    heads = ordered.first_per_key(df, [row], order, width)
    place = F.struct(*[F.col(c) for c in order], F.col(value).alias("__v"))
    return heads.groupBy(row).agg(F.sort_array(F.collect_list(place)).alias("__a")).select(
        row, *[F.get("__a", F.lit(i))["__v"].alias(f"category_{i + 1}") for i in range(width)]
    )
