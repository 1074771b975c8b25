"""Tables of other databases through JDBC, and discovery of tables in a folder."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def remote_table(
    spark: SparkSession, url: str, table: str, properties: Mapping[str, str], partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, parts: int = 32,
) -> DataFrame:
    """Remote table read in parallel ranges; filters, columns and limits are pushed to the server.

    The driver class of the remote database must be on the class path.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties).option("pushDownPredicate", "true")
    if partition_column and bounds:
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
        )
    return reader.load()


def remote_query(spark: SparkSession, url: str, query: str, properties: Mapping[str, str]) -> DataFrame:
    """Rows of a statement that runs on the server."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**properties).load()


def remote_slices(spark: SparkSession, url: str, table: str, predicates: Sequence[str], properties: Mapping[str, str]) -> DataFrame:
    """Remote table read by one task per predicate; the predicates must not overlap."""
    return spark.read.jdbc(url, table, predicates=list(predicates), properties=dict(properties))


def import_schema(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a folder by name, with the schemas their files declare."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
