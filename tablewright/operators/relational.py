"""Row-set operators: inheritance, domains, row filters, sampling, cursors, bags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tablewright.operators import ordered
from tablewright.session import scratch_path


def with_children(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """Parent rows and the parent's columns of every child."""
    out = parent
    for child in children:
        out = out.unionByName(child.select(*[c for c in child.columns if c in parent.columns]), allowMissingColumns=True)
    return out


def domain_check(df: DataFrame, rule: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a domain rule (NULL passes) and rows that do not."""
    ok = F.coalesce(rule, F.lit(True))
    return df.filter(ok), df.filter(~ok)


def row_filtered(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows the current user may see: each user has a SQL predicate, others see none."""
    allowed = F.lit(False)
    for user, predicate in rules.items():
        allowed = allowed | ((F.current_user() == user) & F.expr(predicate))
    return df.filter(allowed)


def _share(percent: float, buckets: int = 1 << 30) -> tuple[int, int]:
    return int(percent / 100.0 * buckets), buckets


def bernoulli(df: DataFrame, percent: float, seed: int, key: Sequence[str]) -> DataFrame:
    """Each row is kept with the given chance; the same rows for the same seed."""
    cutoff, buckets = _share(percent)
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(buckets)) < cutoff)


def system_sample(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Whole file blocks are kept with the given chance. ``df`` must be a file scan."""
    cutoff, buckets = _share(percent)
    block = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.lit(seed))
    return df.filter(F.pmod(block, F.lit(buckets)) < cutoff)


def reservoir(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Uniform sample of exactly ``n`` rows: the ``n`` smallest seeded hashes of a unique key."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


class Cursor:
    """A result kept in order, read by position in any direction.

    The result is stored once, cut along its order into chunks (folders of a partition column), with a directory of the
    rows in each: so a position, absolute, relative or from the end, is in one chunk, and a fetch opens only the chunks
    its range touches. The directory has at most ``ordered.MAX_CHUNKS`` rows. NULL keys come last. Rows with equal keys
    stand in the order of their other columns; rows alike in all are told apart by nothing.

    The cursor stands before the first row (position 0), on the row fetched last, or after the last row. ``fetch`` and
    ``move`` take ``next``, ``prior``, ``first``, ``last``, ``absolute`` and ``relative`` with a number, and ``forward``
    and ``backward`` with a number or ``"all"``.
    """

    def __init__(self, df: DataFrame, order: Sequence[str], scroll: bool = True, chunks: int | None = None):
        self.scroll, self.at, self.columns = scroll, 0, df.columns
        named = [n for n, _ in ordered.parse_order(order)]
        plain = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant") and f.name not in named]
        self.order = [*order, *plain]
        path = scratch_path(df.sparkSession, "cursor")
        self.bounds = {}
        placed = df.withColumn("__chunk", ordered.chunk_of(df, list(order), chunks).cast("int"))
        placed.repartition("__chunk").write.partitionBy("__chunk").parquet(path)
        # an empty result leaves no folder to read a schema from
        kept = df.sparkSession.read.schema(StructType([*df.schema.fields, StructField("__chunk", IntegerType())])).parquet(path)
        self.stored = kept
        self.count = 0
        for r in kept.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n")).orderBy("__chunk").collect():
            self.bounds[r["__chunk"]] = (self.count, self.count + r.n)
            self.count += r.n

    def _range(self, first: int, last: int) -> DataFrame:
        """Rows from one position to another, with ``position``."""
        chunks = [c for c, (a, b) in self.bounds.items() if a < last and b >= first]
        few = self.stored.filter(F.col("__chunk").isin(chunks))
        starts = F.create_map(*[F.lit(x) for c in chunks for x in (c, self.bounds[c][0])]) if chunks else F.lit(None).cast("map<int,int>")
        number = F.row_number().over(Window.partitionBy("__chunk").orderBy(*ordered.sort_columns(self.order)))
        return few.withColumn("position", (starts[F.col("__chunk")] + number).cast("long")).filter(F.col("position").between(first, last)).drop("__chunk")

    def _span(self, direction: str, n: int | str | None) -> tuple[int, int, bool]:
        """First and last position asked for, and whether they are read backward; moves the cursor."""
        at, end = self.at, self.count + 1
        if direction in ("next", "prior"):
            direction, n = ("forward" if direction == "next" else "backward"), 1
        if direction in ("first", "last"):
            direction, n = "absolute", 1 if direction == "first" else -1
        if direction in ("forward", "backward") and isinstance(n, int) and n < 0:
            direction, n = ("backward" if direction == "forward" else "forward"), -n
        if direction in ("forward", "backward") and n == 0:
            direction = "relative"
        if direction in ("absolute", "relative"):
            goal = at + n if direction == "relative" else n if n >= 0 else end + n
            goal = min(max(goal, 0), end)
            if goal < at or (goal == at and not 0 < at < end):
                self._backward(goal < at)
            self.at = goal
            return goal, goal, False
        if direction == "forward":
            first, last = at + 1, self.count if n == "all" else min(at + n, self.count)
            self.at = end if n == "all" or at + n > self.count else last
            return first, last, False
        if direction == "backward":
            self._backward(True)
            first, last = 1 if n == "all" else max(at - n, 1), at - 1
            self.at = 0 if n == "all" or at - n < 1 else first
            return first, last, True
        raise ValueError(direction)

    def _backward(self, goes_back: bool) -> None:
        if goes_back and not self.scroll:
            raise ValueError("this cursor can only scan forward")

    def fetch(self, direction: int | str = "next", n: int | str | None = None) -> DataFrame:
        """Rows in the order they are passed; a number alone is ``forward``."""
        rows = self.fetch_numbered(direction, n)
        return rows.drop("position")

    def fetch_numbered(self, direction: int | str = "next", n: int | str | None = None) -> DataFrame:
        """The same with ``position``, the row's number from 1."""
        if isinstance(direction, int):
            direction, n = "forward", direction
        first, last, backward = self._span(direction, n)
        first, last = max(first, 1), min(last, self.count)
        return self._range(first, last).orderBy(F.desc("position") if backward else "position")

    def move(self, direction: int | str = "next", n: int | str | None = None) -> int:
        """Reposition without reading; returns how many rows a fetch would have given."""
        if isinstance(direction, int):
            direction, n = "forward", direction
        first, last, _ = self._span(direction, n)
        return max(0, min(last, self.count) - max(first, 1) + 1)


def _bag(a: DataFrame, b: DataFrame) -> DataFrame:
    cols = a.columns
    one = lambda df, x, y: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select(*cols, (F.col("n") * x).alias("__a"), (F.col("n") * y).alias("__b"))
    sides = one(a, 1, 0).unionByName(one(b, 0, 1))
    return sides.groupBy(*cols).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))


def _repeat(df: DataFrame, cols: Sequence[str], times: Column) -> DataFrame:
    return df.withColumn("__n", times).filter("__n > 0").select(*cols, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag intersection over counts, so copies of a row cross the shuffle as one."""
    return _repeat(_bag(a, b), a.columns, F.least("__a", "__b"))


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag difference over counts."""
    return _repeat(_bag(a, b), a.columns, F.col("__a") - F.col("__b"))


def next_values(df: DataFrame, order: Sequence[str], start: int = 1, step: int = 1, into: str = "nextval") -> DataFrame:
    """Sequence numbers in the given order, without gaps."""
    numbered = ordered.number_rows(df, [], order, into)
    return numbered.withColumn(into, (F.col(into) - 1) * step + start)
