"""Changes to tables as new tables.

Each function takes the current rows and gives the new rows together with the
rows that changed, so a caller can write the one and return the other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators import ordered


@dataclass(frozen=True)
class Change:
    table: DataFrame
    returning: DataFrame


def _like(df: DataFrame, schema_of: DataFrame) -> DataFrame:
    types = {f.name: f.dataType for f in schema_of.schema.fields}
    return df.select(*[F.col(c).cast(types[c]).alias(c) for c in schema_of.columns])


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> Change:
    """Append rows; columns not given take their default or NULL."""
    for name in table.columns:
        if name not in rows.columns:
            rows = rows.withColumn(name, (defaults or {}).get(name, F.lit(None)))
    added = _like(rows, table)
    return Change(table.unionByName(added), added)


def update(table: DataFrame, key: Sequence[str], source: DataFrame, assign: Mapping[str, Column], order: Sequence[str] | None = None) -> Change:
    """``UPDATE .. SET .. FROM source``: source columns must have other names than the table's.

    When several source rows meet one key the first in ``order`` is used.
    """
    once = ordered.first_per_key(source, list(key), order) if order else source.dropDuplicates(list(key))
    joined = table.join(once.withColumn("__hit", F.lit(True)), list(key), "left")
    changed = {c: F.when(F.col("__hit"), assign[c].cast(table.schema[c].dataType)).otherwise(F.col(c)) if c in assign else F.col(c) for c in table.columns}
    full = joined.select(*[v.alias(c) for c, v in changed.items()], "__hit")
    return Change(full.drop("__hit"), full.filter("__hit").drop("__hit"))


def delete(table: DataFrame, key: Sequence[str], source: DataFrame) -> Change:
    """``DELETE .. USING source``."""
    keys = source.select(*key).distinct()
    return Change(table.join(keys, list(key), "left_anti"), table.join(keys, list(key), "left_semi"))


class DuplicateProposal(ValueError):
    """Two proposed rows meet one key."""


def upsert(
    table: DataFrame, proposed: DataFrame, key: Sequence[str], assign: Mapping[str, Column] | None = None,
    where: Column | None = None, order: Sequence[str] | None = None,
) -> Change:
    """``INSERT .. ON CONFLICT``.

    Without ``assign`` conflicting rows are skipped. ``assign`` and ``where`` may use
    the proposed row as ``excluded.<column>``; with it a key proposed twice is an error.
    """
    key = list(key)
    if assign is not None:
        twice = proposed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1)
        if not twice.isEmpty():
            raise DuplicateProposal("a key is proposed more than once")
        fresh = proposed
    else:
        fresh = ordered.first_per_key(proposed, key, order) if order else proposed.dropDuplicates(key)
    fresh = _like(fresh, table)
    new_rows = fresh.join(table.select(*key), key, "left_anti")
    if assign is None:
        return Change(table.unionByName(new_rows), new_rows)
    excluded = fresh.select(*key, F.struct(*fresh.columns).alias("excluded"))
    joined = table.join(excluded, key, "left")
    hit = F.col("excluded").isNotNull()
    if where is not None:
        hit = hit & F.coalesce(where, F.lit(False))
    joined = joined.withColumn("__hit", hit)
    cols = [
        (F.when(F.col("__hit"), assign[c].cast(table.schema[c].dataType)).otherwise(F.col(c)) if c in assign else F.col(c)).alias(c)
        for c in table.columns
    ]
    kept = joined.select(*cols, "__hit")
    return Change(kept.drop("__hit").unionByName(new_rows), kept.filter("__hit").drop("__hit").unionByName(new_rows))


def diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that differ: ``op`` I, U or D, the key, and both row images."""
    key = list(key)
    a = old.select(*key, F.struct(*old.columns).alias("before"))
    b = new.select(*key, F.struct(*old.columns).alias("after"))
    op = F.when(F.col("before").isNull(), "I").when(F.col("after").isNull(), "D").when(F.col("before") != F.col("after"), "U")
    return a.join(b, key, "full").withColumn("op", op).filter("op is not null")


def apply_diff(old: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows with a diff applied."""
    kept = old.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.filter("op <> 'D'").select("after.*"))


def notifications(changes: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """One text per changed row: table, operation letter and key values."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f"\"{k}\"='"), F.replace(F.col(k).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")) for k in key])
    return changes.select(*key, "op", F.concat(F.lit(f'"{table}",'), F.col("op"), F.lit(","), pairs).alias("payload"))


# -- constraints ---------------------------------------------------------------


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the names of the rules they break. NULL passes."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules.items()]))
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def unique_violations(df: DataFrame, key: Sequence[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once; a primary key must not be NULL either."""
    no_null = None
    for k in key:
        no_null = F.col(k).isNotNull() if no_null is None else no_null & F.col(k).isNotNull()
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(((F.col("n") > 1) & no_null) | (~no_null if primary else F.lit(False)))


def orphans(child: DataFrame, parent: DataFrame, fk: Sequence[str], pk: Sequence[str]) -> DataFrame:
    """Child rows whose key, when fully known, is not in the parent."""
    on = [F.col(f"c.{a}") == F.col(f"p.{b}") for a, b in zip(fk, pk)]
    known = child.alias("c")
    for a in fk:
        known = known.filter(F.col(f"c.{a}").isNotNull())
    return known.join(parent.select(*pk).alias("p"), on, "left_anti")


def on_parent_delete(child: DataFrame, deleted: DataFrame, fk: Sequence[str], pk: Sequence[str], action: str) -> DataFrame:
    """Child rows after parent rows are gone: ``cascade``, ``set null`` or ``restrict``."""
    keys = deleted.select(*[F.col(b).alias(f"__{a}") for a, b in zip(fk, pk)]).distinct()
    on = [F.col(a) == F.col(f"__{a}") for a in fk]
    if action == "cascade":
        return child.join(keys, on, "left_anti")
    if action == "restrict":
        if not child.join(keys, on, "left_semi").limit(1).isEmpty():
            raise ValueError("rows refer to the deleted keys")
        return child
    joined = child.join(keys.withColumn("__hit", F.lit(True)), on, "left")
    return joined.select(*[F.when(F.col("__hit"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fk else F.col(c) for c in child.columns])


# -- history -------------------------------------------------------------------

OPEN_END = "9999-12-31 00:00:00"  # fixed value: end of a version that is still valid


def history_from_changes(changes: DataFrame, key: Sequence[str], at: str, tie: str, deleted: Column) -> DataFrame:
    """Validity interval of each version of each key from a list of changes."""
    seen = changes.withColumn("__dead", deleted)
    nxt = ordered.sliding(seen, list(key), [at, tie], 0, 1, {"valid_to": lambda w: F.lead(at).over(w)})
    return (
        nxt.filter("not __dead").drop("__dead").withColumnRenamed(at, "valid_from")
        .withColumn("valid_to", F.coalesce("valid_to", F.lit(OPEN_END).cast(changes.schema[at].dataType)))
    )


def history_apply(history: DataFrame, changes: DataFrame, key: Sequence[str], at: str, deleted: str) -> DataFrame:
    """Close open versions of changed keys at the change time and open the new ones.

    ``changes`` holds one row per key: the value columns, the time and a deleted flag.
    """
    key = list(key)
    end = F.lit(OPEN_END).cast(history.schema["valid_to"].dataType)
    closing = changes.select(*key, F.col(at).alias("__at"))
    joined = history.join(closing, key, "left")
    closed = joined.withColumn(
        "valid_to", F.when((F.col("valid_to") == end) & F.col("__at").isNotNull(), F.col("__at")).otherwise(F.col("valid_to"))
    ).drop("__at")
    opened = changes.filter(~F.col(deleted)).withColumn("valid_from", F.col(at)).withColumn("valid_to", end)
    return closed.unionByName(_like(opened, history))


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """Versions valid at a moment."""
    return history.filter((F.col("valid_from") <= at) & (at < F.col("valid_to")))


def audit_columns(df: DataFrame, modified: str | None = None, user: str | None = None, serial: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Stamp rows with the time, the user and a serial number."""
    if modified:
        df = df.withColumn(modified, F.current_timestamp())
    if user:
        df = df.withColumn(user, F.current_user())
    if serial:
        df = ordered.number_rows(df, [], list(order), serial)
    return df


# -- physical order ------------------------------------------------------------


def clustered(df: DataFrame, by: Sequence[str], tie: Sequence[str], files: int) -> DataFrame:
    """Rows in range-partitioned, sorted parts. ``tie`` splits a value that fills many files."""
    return df.repartitionByRange(files, *by, *tie).sortWithinPartitions(*by, *tie)


def compacted(df: DataFrame, rows_per_file: int = 5_000_000) -> DataFrame:
    """Rows in as few files as the row target allows."""
    return df.repartition(max(1, -(-df.count() // rows_per_file)))
