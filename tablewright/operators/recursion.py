"""Recursive queries as driver loops over written rounds."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import scratch_path


#: Rows seen that one part holds, about, after it was rewritten.
PART_ROWS = 250_000
#: Rounds after which the parts are rewritten at the latest, so that a part stays a few files.
REWRITE_ROUNDS = 16


class Seen:
    """Distinct rows found so far, dealt by hash into parts on storage.

    A round opens only the parts that its new candidates fall in, so its cost follows the candidates and not the rows
    seen: with few candidates few parts, each about ``PART_ROWS``. Once the rows have doubled, or every
    ``REWRITE_ROUNDS`` rounds, they are dealt anew into as many parts as they fill.
    """

    def __init__(self, spark, base: str, schema):
        self.spark, self.base, self.schema, self.names = spark, base, schema, schema.fieldNames()
        self.generation, self.parts, self.rows, self.rewritten, self.since = 0, 16, 0, 0, 0
        self.paths: dict[int, list[str]] = {}
        #: parts opened, by round
        self.opened: list[int] = []

    def _dealt(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__part", F.pmod(F.xxhash64(*self.names), F.lit(self.parts)).cast("int"))

    def _write(self, df: DataFrame, label: str) -> dict[int, int]:
        """Rows by part that were written."""
        path = f"{self.base}/g{self.generation}/{label}"
        self._dealt(df).repartition("__part").write.partitionBy("__part").parquet(path)
        sizes = {r["__part"]: r.n for r in self._read([path]).groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
        for part in sizes:
            self.paths.setdefault(part, []).append(f"{path}/__part={part}")
        return sizes

    def _read(self, paths: list[str], dealt: bool = True) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("__part", T.IntegerType())] if dealt else self.schema.fields
        return self.spark.read.schema(T.StructType(fields)).parquet(*paths)

    def all(self) -> DataFrame:
        found = [p for part in self.paths.values() for p in part]
        return self._read(found, dealt=False) if found else self.spark.createDataFrame([], self.schema)

    def add(self, candidates: DataFrame, number: int) -> DataFrame | None:
        """Keep and return the candidates not seen before; None if there are none."""
        path = f"{self.base}/candidates/{number}"
        self._dealt(candidates.distinct()).write.parquet(path)
        fresh = self._read([path])
        touched = [r["__part"] for r in fresh.select("__part").distinct().collect()]
        held = [p for part in touched for p in self.paths.get(part, [])]
        self.opened.append(len([t for t in touched if t in self.paths]))
        if held:
            row = lambda df: df.withColumn("__row", F.struct(*self.names))
            fresh = row(fresh).join(row(self._read(held, dealt=False)).select("__row"), "__row", "left_anti")
        label = f"round-{number}"
        sizes = self._write(fresh.select(*self.names), label)
        if not sizes:
            return None
        new = self._read([f"{self.base}/g{self.generation}/{label}"], dealt=True).select(*self.names)
        self.rows, self.since = self.rows + sum(sizes.values()), self.since + 1
        if self.rows > 2 * max(self.rewritten, self.parts * PART_ROWS // 4) or self.since >= REWRITE_ROUNDS:
            self._rewrite()
        return new

    def _rewrite(self) -> None:
        rows = self.all()
        self.generation, self.paths, self.since = self.generation + 1, {}, 0
        # few rows are in more and smaller parts, so that few candidates open few of them
        self.parts = max(16, 2 * self.rows // PART_ROWS, min(256, math.isqrt(self.rows)))
        self._write(rows, "rewritten")
        self.rewritten = self.rows


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int | None = None) -> DataFrame:
    """``WITH RECURSIVE``: apply ``step`` to the newest rows until none are left.

    With ``distinct`` rows already seen are dropped (``UNION``), so cycles end; see :class:`Seen`. Every round is written
    to the shared directory: the plan of a round is a scan and a join, however many rounds came before, and a lost
    executor costs no round twice. ``max_rounds`` stops a recursion that need not end with an error.
    """
    spark, names = seed.sparkSession, seed.columns
    base = scratch_path(spark, "recursion")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in seed.schema.fields])
    typed = lambda df: df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    if distinct:
        seen, number = Seen(spark, base, schema), 0
        frontier = seen.add(typed(seed), 0)
        while frontier is not None:
            number += 1
            if max_rounds is not None and number > max_rounds:
                raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
            frontier = seen.add(typed(step(frontier).select(*names)), number)
        return seen.all()

    def store(df: DataFrame, number: int) -> DataFrame:
        typed(df).write.parquet(f"{base}/round={number}")
        return spark.read.schema(schema).parquet(f"{base}/round={number}")

    frontier, number = store(seed, 0), 0
    while not frontier.isEmpty():
        number += 1
        if max_rounds is not None and number > max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        frontier = store(step(frontier).select(*names), number)
    return spark.read.schema(schema).parquet(base).select(*names)


def connect_by(
    tree: DataFrame, key: str, parent: str, start: Column, order: Sequence[str] = (), separator: str = "~",
    max_depth: int | None = None,
) -> DataFrame:
    """Hierarchy walk: ``key``, ``parent``, ``level`` and the ``branch`` of keys from the start row.

    A branch never visits a key twice, so cycles in the data end.
    """
    links = tree.select(F.col(key).alias("__k"), F.col(parent).alias("__p"))
    seed = tree.filter(start).select(
        F.col(key), F.lit(None).cast(tree.schema[parent].dataType).alias(parent), F.lit(0).alias("level"),
        F.array(F.col(key)).alias("__path"),
    )

    def step(level: DataFrame) -> DataFrame:
        grown = level.join(links, F.col(key) == F.col("__p"))
        if max_depth is not None:
            grown = grown.filter(F.col("level") < max_depth)
        return grown.filter(~F.array_contains("__path", F.col("__k"))).select(
            F.col("__k").alias(key), F.col("__p").alias(parent), (F.col("level") + 1).alias("level"),
            F.array_append("__path", F.col("__k")).alias("__path"),
        )

    rows = fixpoint(seed, step, distinct=False)
    return rows.withColumn("branch", F.array_join(F.transform("__path", lambda x: x.cast("string")), separator)).drop("__path")
