"""Change feeds applied and produced."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablewright.functions import textsearch as ts
from tablewright.operators import ordered
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.streaming import changes


def op_of(kind):
    return F.when(kind == "signup", "I").when(kind == "error", "D").otherwise("U")


def in_turns(t, feed, key, seq, full, derive=None):
    """Apply a feed that arrives in three turns, in order, compacting after all but the last; returns the target."""
    base = scratch_path(t.spark, "changes")
    third = ordered.chunk_of(feed, [seq], 3)
    files = 1 + math.isqrt(feed.count()) // 1000
    for turn in range(3):
        part = feed.filter(third == turn) if turn < 2 else feed.filter(third >= 2)
        part.repartitionByRange(files, seq).write.mode("append").parquet(f"{base}/feed")
        changes.start_apply(t.spark, f"{base}/feed", feed.schema, f"{base}/target", key, seq, f"{base}/offsets", derive, files_per_batch=max(1, files // 2)).awaitTermination()
        if turn < 2:
            changes.compact(t.spark, f"{base}/target", key, seq, full=full)
    return f"{base}/target"


@query(
    "cdc_apply", "2.23.1",
    """
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'
    """,
)
def cdc_apply(t):
    feed = t.events.select("user_id", "event_id", "value", op_of(F.col("event_type")).alias("op"))
    target = in_turns(t, feed, ["user_id"], "event_id", full=False)
    return changes.current(t.spark, target, ["user_id"], "event_id").select("user_id", "event_id", "value")


@query(
    "change_feed_text", "2.23.1",
    """
    WITH c AS (SELECT event_id // 10 AS xid, event_id, user_id, event_type FROM events WHERE event_type IN ('signup', 'error', 'click'))
    SELECT xid, 1 AS part, event_id AS seq, 'table events: ' || CASE event_type WHEN 'signup' THEN 'INSERT: event_id[bigint]:' || event_id || ' user_id[bigint]:' || user_id || ' event_type[string]:''signup'''
             WHEN 'error' THEN 'DELETE: event_id[bigint]:' || event_id ELSE 'UPDATE: event_id[bigint]:' || event_id || ' user_id[bigint]:' || user_id || ' event_type[string]:''click''' END AS data FROM c
    UNION ALL SELECT DISTINCT xid, 0, 0, 'BEGIN ' || xid FROM c UNION ALL SELECT DISTINCT xid, 2, 0, 'COMMIT ' || xid FROM c
    """,
)
def change_feed_text(t):
    c = t.events.filter("event_type IN ('signup', 'error', 'click')").select(
        F.expr("event_id div 10").alias("xid"), "event_id", "user_id", "event_type", op_of(F.col("event_type")).alias("op")
    )
    return changes.feed_texts(c, "events", ["event_id"], ["event_id", "user_id", "event_type"], "op", "xid", "event_id")


@query(
    "derived_column_upkeep", "2.23.3 2.20.13",
    r"""
    SELECT conv_id, turn, len(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')))::INTEGER AS words FROM conversations c
    WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id)
    """,
)
def derived_column_upkeep(t):
    feed = t.conversations.select("conv_id", "turn", "text", F.lit("U").alias("op"))
    derive = lambda rows: rows.withColumn("words", ts.length(ts.to_vector(F.col("text"))))
    target = in_turns(t, feed, ["conv_id"], "turn", full=True, derive=derive)
    return changes.current(t.spark, target, ["conv_id"], "turn").select("conv_id", "turn", "words")


@query("unchanged_updates_dropped", "2.23.3", "SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment, c_mktsegment AS old FROM customer) WHERE c_mktsegment <> old")
def unchanged_updates_dropped(t):
    proposed = t.customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "DEBT").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return changes.drop_unchanged(proposed, t.customer, ["c_custkey"], ["c_mktsegment"])
