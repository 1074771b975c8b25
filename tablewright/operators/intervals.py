"""Jobs over intervals: packing, gaps, exclusion conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ordered


def _reach(df: DataFrame, keys: Sequence[str], lower: str, upper: str, tie: Sequence[str]) -> DataFrame:
    """Rows with the greatest upper bound of all earlier rows of the key."""
    return ordered.running(df, keys, [lower, upper, *tie], {"__reach": ("max", upper)}, inclusive=False)


def pack(df: DataFrame, keys: Sequence[str], lower: str, upper: str) -> DataFrame:
    """Merge overlapping or touching half-open intervals of each key."""
    spans = df.select(*keys, lower, upper).filter(F.col(lower) < F.col(upper)).distinct()
    marked = _reach(spans, keys, lower, upper, [])
    starts = marked.withColumn("__new", F.when(F.col("__reach").isNull() | (F.col("__reach") < F.col(lower)), 1).otherwise(0))
    islands = ordered.running(starts, keys, [lower, upper], {"__island": ("sum", "__new")})
    return islands.groupBy(*keys, "__island").agg(
        F.min(lower).alias(lower), F.max(upper).alias(upper), F.count(F.lit(1)).alias("parts")
    ).drop("__island")


def gaps(df: DataFrame, keys: Sequence[str], lower: str, upper: str) -> DataFrame:
    """Uncovered stretches between the first and last interval of each key."""
    spans = df.select(*keys, lower, upper).filter(F.col(lower) < F.col(upper)).distinct()
    marked = _reach(spans, keys, lower, upper, [])
    return marked.filter(F.col("__reach") < F.col(lower)).select(
        *keys, F.col("__reach").alias("gap_from"), F.col(lower).alias("gap_to")
    )


def exclusion_conflicts(df: DataFrame, keys: Sequence[str], lower: str, upper: str, row_id: str) -> DataFrame:
    """Rows that overlap an earlier row of the same key."""
    real = df.filter(F.col(lower) < F.col(upper))
    marked = _reach(real, keys, lower, upper, [row_id])
    return marked.filter(F.col("__reach") > F.col(lower)).drop("__reach")
