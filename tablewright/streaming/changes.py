"""Change data: a keyed table kept as runs of changes behind a manifest, and feed texts.

A micro-batch appends the latest change per key as a run of its own and names it in the manifest; a batch that is run
again is known there and changes nothing. Reading merges the runs by sequence number. :func:`compact` folds the batches
into a level, together with the newer levels that are not much larger, so that a large base is rewritten only when as
much has come together; the folded runs leave the manifest. The cost of a batch follows the changes, not the table.
"""

from __future__ import annotations

import functools
import uuid
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.joins import broadcast_if_small
from tablewright.sources.manifests import Manifest, Run, Store

#: A compaction takes in a level of up to so many times the rows that it folds already.
GROWTH = 4
#: Newer rows up to which an older run is merged without being shuffled.
SMALL_ROWS = 100_000


def latest(changes: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Newest change of each key; reduced before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(*key, "r.*")


def start_apply(
    spark: SparkSession, source: str, schema, target: str, key: Sequence[str], seq: str, checkpoint: str,
    derive: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Stream change files into ``target`` until all present files are done.

    ``derive`` adds columns that depend on the others, for changed rows only. A batch is known by its number and the
    folder of its offsets.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream_name = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, number: int) -> None:
        store, name = Store(spark, target), f"batch-{stream_name}-{number:08d}"
        if store.read().knows(name):
            return
        rows = latest(batch, key, seq)
        if derive is not None:
            rows = derive(rows)
        rows.write.mode("overwrite").parquet(store.path(name))
        n = spark.read.parquet(store.path(name)).count()
        store.change(lambda m: None if m.knows(name) else Manifest(runs=(*m.runs, Run(name, n)), folded=m.folded))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_runs(store: Store, runs: Sequence[Run]) -> DataFrame:
    """Rows of some runs; a column that a run lacks is NULL in it."""
    parts = [store.spark.read.parquet(store.path(r.name)) for r in runs]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(store: Store, runs: Sequence[Run], key: Sequence[str], seq: str) -> DataFrame:
    """Newest image of each key, deletes included. The oldest run, commonly the largest, is scanned once and not
    shuffled if all newer rows are few; otherwise all runs are grouped by key."""
    first, newer = runs[0], list(runs[1:])
    if not newer:
        rows = read_runs(store, [first])
        return rows if first.level else latest(rows, key, seq)
    if not first.level or sum(r.rows for r in newer) > SMALL_ROWS:
        return latest(read_runs(store, runs), key, seq)
    base, recent = read_runs(store, [first]), latest(read_runs(store, newer), key, seq)
    rest = [c for c in dict.fromkeys([*base.columns, *recent.columns]) if c not in key]
    image = lambda df: F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).alias(c) for c in rest])
    old, new = base.select(*key, image(base).alias("o")), recent.select(*key, image(recent).alias("n"))
    same = lambda a, b: functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])
    few, known = broadcast_if_small(new, SMALL_ROWS), base.select(*key)
    replaced = old.join(few, same(old, new), "left").select(*[old[k] for k in key], F.when(F.col("n").isNull() | (F.col(f"o.{seq}") > F.col(f"n.{seq}")), F.col("o")).otherwise(F.col("n")).alias("r"))
    # keys that the base has, of the few
    few = few.select(*key)
    found = known.join(few, same(known, few), "left_semi").distinct()
    added = new.join(broadcast_if_small(found, SMALL_ROWS), same(new, found), "left_anti").select(*key, F.col("n").alias("r"))
    return replaced.unionByName(added).select(*key, "r.*")


def current(spark: SparkSession, target: str, key: Sequence[str], seq: str, op: str = "op", number: int | None = None) -> DataFrame:
    """Rows alive now, or in an earlier manifest that is still kept: the newest image of each key unless it is a delete."""
    store = Store(spark, target)
    runs = store.read(number).runs
    if not runs:
        raise FileNotFoundError(target)
    return merged(store, runs, key, seq).filter(F.col(op) != "D")


def compact(spark: SparkSession, target: str, key: Sequence[str], seq: str, op: str = "op", full: bool = False) -> Manifest:
    """Fold the batches, and the newer levels that are not much larger, into one level; all of them if ``full``.

    Deletes stay in a level as long as an older level may hold the row.
    """
    store = Store(spark, target)
    now = store.read()
    taken, rows = now.batches, sum(r.rows for r in now.batches)
    for level in reversed(now.levels):
        if not full and level.rows > GROWTH * rows:
            break
        taken, rows = [level, *taken], rows + level.rows
    if not taken or (len(taken) == 1 and taken[0].level):
        return now
    folded = merged(store, taken, key, seq)
    oldest = len([r for r in taken if r.level]) == len(now.levels)
    if oldest:
        folded = folded.filter(F.col(op) != "D")
    name = f"level-{uuid.uuid4().hex[:12]}"
    folded.write.parquet(store.path(name))
    made, gone = Run(name, spark.read.parquet(store.path(name)).count(), True), {r.name for r in taken}

    def edit(m: Manifest) -> Manifest:
        kept = [r for r in m.runs if r.name not in gone]
        levels = [r for r in kept if r.level]
        return Manifest(runs=(*levels, made, *[r for r in kept if not r.level]), folded=m.folded_with([r.name for r in taken if not r.level]))

    return store.change(edit)


def drop_unchanged(changes: DataFrame, stored: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Changes that differ from the stored row in one of the columns."""
    old = stored.select(*key, F.struct(*columns).alias("__old"))
    return changes.join(old, list(key), "left").filter(F.col("__old").isNull() | (F.struct(*columns) != F.col("__old"))).drop("__old")


# Words of the feed text for each operation.
FEED_WORDS = {"I": "INSERT", "U": "UPDATE", "D": "DELETE"}

#: Types whose values a feed shows without quotes.
PLAIN = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")


def feed_texts(
    changes: DataFrame, table: str, key: Sequence[str], columns: Sequence[str], op: str, xid: str, seq: str,
    include_xids: bool = True, skip_empty: bool = True, all_xids: DataFrame | None = None,
) -> DataFrame:
    """Feed lines in transaction order: BEGIN, one line per row change, COMMIT.

    A delete lists the key only. With ``skip_empty`` off, ``all_xids`` names the
    transactions that changed nothing here but are shown all the same.
    """
    types = {f.name: f.dataType.simpleString() for f in changes.schema.fields}

    def cell(c: str) -> Column:
        v = F.col(c).cast("string")
        shown = v if types[c].split("(")[0] in PLAIN else F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.concat(F.lit(f"{c}[{types[c]}]:"), F.coalesce(shown, F.lit("null")))

    word = F.col(op)
    for letter, text in FEED_WORDS.items():
        word = F.when(F.col(op) == letter, F.lit(text)).otherwise(word)
    body = F.when(F.col(op) == "D", F.concat_ws(" ", *[cell(c) for c in key])).otherwise(F.concat_ws(" ", *[cell(c) for c in columns]))
    lines = changes.select(
        F.col(xid).alias("xid"), F.lit(1).alias("part"), F.col(seq).cast("long").alias("seq"),
        F.concat(F.lit(f"table {table}: "), word, F.lit(": "), body).alias("data"),
    )
    xids = changes.select(F.col(xid).alias("xid"))
    if not skip_empty and all_xids is not None:
        xids = xids.union(all_xids.select(F.col(xid).alias("xid")))
    tail = F.concat(F.lit(" "), F.col("xid").cast("string")) if include_xids else F.lit("")
    marks = xids.distinct().select(
        "xid", F.explode(F.array(
            F.struct(F.lit(0).alias("part"), F.concat(F.lit("BEGIN"), tail).alias("data")),
            F.struct(F.lit(2).alias("part"), F.concat(F.lit("COMMIT"), tail).alias("data")),
        )).alias("m"),
    ).select("xid", "m.part", F.lit(0).cast("long").alias("seq"), "m.data")
    return lines.unionByName(marks)
