"""What the operators of this package share: word splitting, stored intermediate tables, Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import scratch_path

#: Words are runs of anything but these six ASCII characters.
BLANKS = r"[\x20\x09-\x0D]"

WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends here and
    a lost executor costs only the tasks it ran."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """Words of a text, unchanged; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS + "+"), "")


def n_words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this library to the Python workers, once per application, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="run-"), "tablewright.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def per_batch(df: DataFrame, build: Callable[[], Callable[[pa.RecordBatch], object]], schema: str) -> DataFrame:
    """Apply ``build()`` once per task, then its result to each Arrow batch.

    The inner function returns a RecordBatch, None, or an iterable of batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = build()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                out = [out]
            for piece in out:
                if piece.num_rows:
                    yield piece

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))
