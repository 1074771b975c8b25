"""Column statistics jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ordered


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and value, values as text. Counted before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attname"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.attname", "p.v").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL fraction, mean width and distinct count of each column, in one pass."""
    counts = value_counts(df, columns)
    known = F.col("v").isNotNull()
    return counts.groupBy("attname").agg(
        (F.sum(F.when(~known, F.col("n")).otherwise(0)) / F.sum("n")).alias("null_frac"),
        (F.sum(F.when(known, F.length("v") * F.col("n"))) / F.sum(F.when(known, F.col("n")))).alias("avg_width"),
        F.count(F.when(known, 1)).alias("n_distinct"),
    )


def approximate_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same with sketched distinct counts: nothing but the sketches is shuffled."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("attname"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.attname").agg(
        F.avg(F.col("p.v").isNull().cast("double")).alias("null_frac"), F.avg(F.length("p.v")).alias("avg_width"),
        F.approx_count_distinct("p.v").alias("n_distinct"),
    )


def most_common_values(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent values of each column with their share of all rows."""
    counts = value_counts(df, columns)
    top = ordered.first_per_key(counts.filter("v is not null"), ["attname"], ["-n", "v"], n)
    total = counts.groupBy("attname").agg(F.sum("n").alias("rows"))
    return top.join(F.broadcast(total), "attname").select("attname", "v", (F.col("n") / F.col("rows")).alias("freq"))


def equi_depth_histogram(df: DataFrame, column: str, bins: int, without: DataFrame | None = None) -> DataFrame:
    """Bounds of bins of equal count, one row, without the values of ``without`` (column ``v``)."""
    rows = df.select(column)
    if without is not None:
        rows = rows.withColumn("__v", F.col(column).cast("string")).join(F.broadcast(without.select(F.col("v").alias("__v"))), "__v", "left_anti")
    probs = {f"b{i}": i / bins for i in range(bins + 1)}
    return ordered.exact_percentiles(rows, [], column, probs, "disc")


def order_correlation(df: DataFrame, column: str, position: Sequence[str]) -> DataFrame:
    """Correlation of the value order with the physical order of rows."""
    placed = ordered.number_rows(df.filter(F.col(column).isNotNull()).select(column, *position), [], list(position), "__pos")
    ranked = ordered.number_rows(placed, [], [column, *position], "__rank")
    return ranked.agg(F.corr("__rank", "__pos").alias("correlation"))


def most_common_elements(df: DataFrame, key: str, elements: Column, n: int) -> DataFrame:
    """Elements found in the most rows, with the share of rows that hold them."""
    rows = df.select(key, F.array_distinct(elements).alias("es"))
    top = rows.select(F.explode("es").alias("element")).groupBy("element").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "element").limit(n)
    total = rows.agg(F.count(F.lit(1)).alias("rows"))
    return top.crossJoin(F.broadcast(total)).select("element", (F.col("n") / F.col("rows")).alias("freq"))


def element_count_histogram(df: DataFrame, elements: Column, bins: int) -> DataFrame:
    """Bounds of the number of distinct elements per row."""
    return equi_depth_histogram(df.select(F.size(F.array_distinct(elements)).alias("n")), "n", bins)


def range_histograms(df: DataFrame, lower: str, upper: str, bins: int) -> DataFrame:
    """Bounds of lower ends, upper ends and lengths of intervals."""
    parts = {"lower": F.col(lower), "upper": F.col(upper), "length": F.col(upper) - F.col(lower)}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("v")) for k, c in parts.items()])).alias("p")).select("p.*")
    return ordered.exact_percentiles(long, ["kind"], "v", {f"b{i}": i / bins for i in range(bins + 1)}, "disc")


def range_fraction(bounds: Sequence[float], value: float) -> float:
    """Share of rows below a value by an equi-depth histogram, linear inside a bin."""
    import bisect

    if value <= bounds[0]:
        return 0.0
    if value >= bounds[-1]:
        return 1.0
    i = bisect.bisect_right(bounds, value) - 1
    lo, hi = bounds[i], bounds[i + 1]
    return (i + (value - lo) / (hi - lo)) / (len(bounds) - 1)


def selectivity_report(df: DataFrame, column: str, bounds: Sequence[float], predicates: Mapping[str, tuple[float, float]], null_frac: float = 0.0) -> DataFrame:
    """Estimated and actual rows of range predicates ``low <= x < high``.

    The two one-sided estimates of a range are combined as high + low - 1.
    """
    guess = {}
    for name, (low, high) in predicates.items():
        below_high, above_low = range_fraction(bounds, high), 1.0 - range_fraction(bounds, low)
        guess[name] = max(below_high + above_low - 1.0 + null_frac, 0.0) if null_frac else max(below_high + above_low - 1.0, 0.0)
    c = F.col(column)
    actual = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if((c >= lo) & (c < hi)).alias(n) for n, (lo, hi) in predicates.items()])
    rows = F.explode(F.array(*[
        F.struct(F.lit(n).alias("predicate"), F.round(F.col("rows") * F.lit(guess[n]), 0).cast("long").alias("estimated"), F.col(n).alias("actual")) for n in predicates
    ]))
    return actual.select(rows.alias("r")).select("r.*")
