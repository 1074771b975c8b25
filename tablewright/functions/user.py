"""Functions defined by users: SQL, vectorised Python and table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def create_sql_function(spark: SparkSession, name: str, args: str, returns: str, body: str) -> None:
    """Scalar SQL function; Spark inlines it into the plan."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")


def create_table_function(spark: SparkSession, name: str, args: str, columns: str, body: str) -> None:
    """SQL function that returns rows."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE({columns}) RETURN {body}")


def strict(function, *columns):
    """Call a function only where no argument is NULL."""
    known = None
    for c in columns:
        known = c.isNotNull() if known is None else known & c.isNotNull()
    return F.when(known, function(*columns))


@F.pandas_udf(T.DoubleType())
def compound(rate: pd.Series, years: pd.Series) -> pd.Series:
    """Growth factor of a yearly rate."""
    return (1.0 + rate) ** years


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("place", T.IntegerType())]))
class SplitWords:
    """One row per blank-separated word."""

    def eval(self, text: str):
        for place, word in enumerate((text or "").split(" "), 1):
            yield word, place
