"""Access to a folder of Parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


class Tables:
    """Tables of one folder as attributes, and SQL over them.

    ``t.orders`` is a DataFrame; ``t.sql("... {orders} ...")`` runs a statement
    in which table names in braces stand for those DataFrames.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str, key: str) -> DataFrame:
        """Table for work that is heavy per row: dealt to all cores when its files
        make fewer tasks than there are cores. A large table is left as it is."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", text))
        for name in used - set(frames):
            frames[name] = getattr(self, name)
        return self.spark.sql(text, **frames)
