"""Tables replaced as a whole: every write makes a new numbered folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _folders(spark: SparkSession, base: str) -> list[int]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        m = re.fullmatch(r"v(\d+)", status.getPath().getName())
        # a folder without the marker belongs to a write that did not finish
        if m and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(m.group(1)))
    return sorted(found)


def publish(df: DataFrame, base: str, partition_by: list[str] | None = None) -> str:
    """Write the next version; readers keep the one they started with."""
    known = _folders(df.sparkSession, base)
    target = f"{base}/v{(known[-1] + 1 if known else 1):06d}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def current(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """Newest finished version, or a given one."""
    known = _folders(spark, base)
    if not known:
        raise FileNotFoundError(base)
    return spark.read.parquet(f"{base}/v{(version or known[-1]):06d}")


def truncate(spark: SparkSession, base: str) -> str:
    """New version without rows."""
    df = current(spark, base)
    return publish(spark.createDataFrame([], df.schema), base)
