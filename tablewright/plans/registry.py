"""Registry of named queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablewright.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None):
    """Register a plan. ``rows`` lists the survey items it covers."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(rows.split()), build, sql)
        return build

    return register
