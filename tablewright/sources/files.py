"""Text and CSV files as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_bad_row"


def export_csv(
    df: DataFrame, path: str, delimiter: str = ",", null: str = "\\N", header: bool = True, quote: str = '"', escape: str = '"',
    force_quote: bool = False,
) -> None:
    """Write rows as CSV parts. NULL is the ``null`` marker and '' an empty pair of quotes; a value equal to the marker
    reads back as NULL."""
    (
        df.write.option("sep", delimiter).option("nullValue", null).option("header", header).option("quote", quote).option("escape", escape)
        .option("quoteAll", force_quote).option("emptyValue", quote * 2)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def import_csv(
    spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", null: str = "\\N", header: bool = True, quote: str = '"',
    escape: str = '"', columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read CSV with a declared schema; any bad row is an error. ``columns`` names the file's columns.

    Quoted values may hold line ends, so a file is read as a whole; write many files.
    """
    used = T.StructType([schema[c] for c in columns]) if columns else schema
    return (
        spark.read.schema(used).option("sep", delimiter).option("nullValue", null).option("header", header).option("quote", quote)
        .option("escape", escape).option("mode", "FAILFAST").option("multiLine", True).option("emptyValue", "").csv(path)
    )


def foreign_csv(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", null: str = "") -> DataFrame:
    """A folder of delimited lines queried in place; lines that do not fit the schema keep their text in ``_bad_row``."""
    wide = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in [*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"sep": delimiter, "nullValue": null, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return spark.read.text(path).select(F.from_csv("value", wide, options).alias("r")).select("r.*")


def split_bad_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and the text of those that do not."""
    return df.filter(f"{CORRUPT} is null").drop(CORRUPT), df.filter(f"{CORRUPT} is not null").select(CORRUPT)


def register_foreign_csv(spark: SparkSession, name: str, path: str, schema: T.StructType, delimiter: str = ",") -> None:
    """Temporary view over a CSV folder."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} ({columns}) USING csv OPTIONS (path '{path}', sep '{delimiter}', header 'true')")
