"""Changes, constraints, history and maintenance of tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.operators import dml, ordered
from tablewright.operators.views import View
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.sources import versions


@query(
    "insert_with_defaults", "2.20.1 2.20.4 2.20.14",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    UNION ALL SELECT 100000000 + s_suppkey, s_name, s_nationkey, 0.0, 'SUPPLIER' FROM supplier
    """,
)
def insert_with_defaults(t):
    rows = t.supplier.select((F.col("s_suppkey") + 100000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"))
    return dml.insert(t.customer, rows, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("SUPPLIER")}).table


@query(
    "update_from", "2.20.2",
    """
    SELECT c_custkey, CASE WHEN n IS NULL THEN c_acctbal ELSE round(c_acctbal + n, 2) END AS c_acctbal, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'ACTIVE' END AS c_mktsegment
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 3) ON c_custkey = o_custkey
    """,
)
def update_from(t):
    busy = t.orders.filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).filter("n > 3")
    out = dml.update(t.customer, ["c_custkey"], busy, {"c_acctbal": F.round(F.col("c_acctbal") + F.col("n"), 2), "c_mktsegment": F.lit("ACTIVE")})
    return out.table.select("c_custkey", "c_acctbal", "c_mktsegment")


@query(
    "delete_using_returning", "2.20.3 2.20.4",
    """
    SELECT 'kept' AS side, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    UNION ALL SELECT 'deleted', count(*), round(sum(o_totalprice), 2) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    """,
)
def delete_using_returning(t):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    out = dml.delete(t.orders, ["o_custkey"], poor)
    tally = lambda side, df: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return tally("kept", out.table).unionByName(tally("deleted", out.returning))


@query(
    "delete_then_insert", "2.8.8",
    """
    SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'archive', count(*) FROM orders WHERE o_orderstatus = 'P'
    """,
)
def delete_then_insert(t):
    moved = dml.delete(t.orders, ["o_orderkey"], t.orders.filter("o_orderstatus = 'P'"))
    base = scratch_path(t.spark, "moved")
    versions.publish(moved.table, f"{base}/orders")
    versions.publish(moved.returning, f"{base}/archive")
    tally = lambda name: versions.current(t.spark, f"{base}/{name}").agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
    return tally("orders").unionByName(tally("archive"))


PROPOSED = "(SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 300000 GROUP BY 1 UNION ALL SELECT 900000000 + s_suppkey, 0, s_acctbal FROM supplier)"


def proposals(t):
    big = t.orders.filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    firms = t.supplier.select((F.col("s_suppkey") + 900000000).alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return big.unionByName(firms).select("c_custkey", F.lit("new").alias("c_name"), F.lit(0).alias("c_nationkey"), "c_acctbal", F.lit("BIG").alias("c_mktsegment"))


@query(
    "upsert_update", "2.20.5",
    f"""
    SELECT c_custkey, c_name, CASE WHEN k IS NOT NULL AND c_nationkey < 20 THEN round(c_acctbal + top, 2) ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN {PROPOSED} ON c_custkey = k
    UNION ALL SELECT k, 'new', top FROM {PROPOSED} WHERE k NOT IN (SELECT c_custkey FROM customer)
    """,
)
def upsert_update(t):
    out = dml.upsert(
        t.customer, proposals(t), ["c_custkey"], {"c_acctbal": F.round(F.col("c_acctbal") + F.col("excluded.c_acctbal"), 2)}, where=F.col("c_nationkey") < 20
    )
    return out.table.select("c_custkey", "c_name", "c_acctbal")


@query("upsert_nothing", "2.20.5 2.20.4", f"SELECT k AS c_custkey, top AS c_acctbal FROM {PROPOSED} WHERE k NOT IN (SELECT c_custkey FROM customer)")
def upsert_nothing(t):
    return dml.upsert(t.customer, proposals(t), ["c_custkey"]).returning.select("c_custkey", "c_acctbal")


@query("truncate_table", "2.20.6", "SELECT 1 AS version, count(*) AS n FROM orders UNION ALL SELECT 2, 0")
def truncate_table(t):
    base = scratch_path(t.spark, "truncate")
    versions.publish(t.orders, base)
    versions.truncate(t.spark, base)
    tally = lambda v: versions.current(t.spark, base, v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n"))
    return tally(1).unionByName(tally(2))


@query(
    "materialized_view_refresh", "2.20.7 2.20.8",
    """
    SELECT o_custkey, CASE WHEN o_custkey % 5 = 0 THEN 'U' ELSE 'same' END AS op, count(*) AS n, CASE WHEN o_custkey % 5 = 0 THEN round(sum(o_totalprice), 2) + 1 ELSE round(sum(o_totalprice), 2) END AS total FROM orders GROUP BY 1
    """,
)
def materialized_view_refresh(t):
    view = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    base = scratch_path(t.spark, "matview")
    versions.publish(view, base)
    stored = versions.current(t.spark, base)
    fresh = view.withColumn("total", F.when(F.col("o_custkey") % 5 == 0, F.col("total") + 1).otherwise(F.col("total")))
    changes = dml.diff(stored, fresh, ["o_custkey"])
    versions.publish(dml.apply_diff(stored, changes, ["o_custkey"]), base)
    now = versions.current(t.spark, base)
    return now.join(changes.select("o_custkey", "op"), "o_custkey", "left").select("o_custkey", F.coalesce("op", F.lit("same")).alias("op"), "n", "total")


@query(
    "check_constraints", "2.20.10 2.2.16",
    """
    SELECT rule, count(*) AS n FROM (
      SELECT unnest(list_filter([CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey > 20 THEN 'segment' END, CASE WHEN nullif(c_nationkey, 7) IS NULL THEN 'nation known' END], lambda x: x IS NOT NULL)) AS rule FROM customer) GROUP BY 1
    """,
)
def check_constraints(t):
    rows = t.customer.withColumn("nation", F.nullif("c_nationkey", F.lit(7)))
    _, bad = dml.check_rows(rows, {
        "balance": F.col("c_acctbal") >= 0, "segment": (F.col("c_mktsegment") != "BUILDING") | (F.col("c_nationkey") <= 20), "nation known": F.col("nation").isNotNull(),
    })
    return bad.select(F.explode("broken").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("unique_violations", "2.20.10", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(t):
    return dml.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"], primary=True)


@query(
    "foreign_keys", "2.20.11",
    """
    WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'), gone AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    SELECT 'orphans' AS what, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p)
    UNION ALL SELECT 'cascade', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM gone)
    UNION ALL SELECT 'set null', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM gone)
    """,
)
def foreign_keys(t):
    kept, gone = t.orders.filter("o_orderstatus <> 'P'"), t.orders.filter("o_orderstatus = 'P'")
    fk, pk = ["l_orderkey"], ["o_orderkey"]
    tally = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    return (
        tally("orphans", dml.orphans(t.lineitem, kept, fk, pk)).unionByName(tally("cascade", dml.on_parent_delete(t.lineitem, gone, fk, pk, "cascade")))
        .unionByName(tally("set null", dml.on_parent_delete(t.lineitem, gone, fk, pk, "set null").filter("l_orderkey is null")))
    )


@query(
    "history_table", "2.20.12",
    """
    SELECT user_id, event_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(nxt, '%Y-%m-%d %H:%M:%S'), '9999-12-31 00:00:00') AS valid_to,
           ts <= TIMESTAMP '2024-01-15' AND coalesce(nxt, TIMESTAMP '9999-12-31') > TIMESTAMP '2024-01-15' AS mid_january
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE event_type <> 'error'
    """,
)
def history_table(t):
    h = dml.history_from_changes(t.events, ["user_id"], "ts", "event_id", F.col("event_type") == "error")
    moment = F.lit("2024-01-15").cast("timestamp_ntz")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return h.select(
        "user_id", "event_id", "value", show("valid_from").alias("valid_from"), show("valid_to").alias("valid_to"),
        ((F.col("valid_from") <= moment) & (moment < F.col("valid_to"))).alias("mid_january"),
    )


@query(
    "history_merge", "2.20.12",
    """
    WITH h AS (SELECT c_custkey, c_acctbal, '2020-01-01' AS valid_from FROM customer), ch AS (SELECT o_custkey, max(o_totalprice) AS v, bool_or(o_orderstatus = 'P') AS dead FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    SELECT c_custkey, c_acctbal, valid_from, CASE WHEN o_custkey IS NULL THEN '9999-12-31' ELSE '2021-06-01' END AS valid_to FROM h LEFT JOIN ch ON c_custkey = o_custkey
    UNION ALL SELECT o_custkey, v, '2021-06-01', '9999-12-31' FROM ch WHERE NOT dead
    """,
)
def history_merge(t):
    ntz = lambda s: F.lit(s).cast("timestamp_ntz")
    h = t.customer.select("c_custkey", "c_acctbal", ntz("2020-01-01").alias("valid_from"), ntz(dml.OPEN_END).alias("valid_to"))
    ch = t.orders.filter("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("c_acctbal"), F.bool_or(F.col("o_orderstatus") == "P").alias("dead")
    ).withColumn("at", ntz("2021-06-01"))
    out = dml.history_apply(h, ch, ["c_custkey"], "at", "dead")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("c_custkey", "c_acctbal", day("valid_from"), day("valid_to"))


@query(
    "audit_stamps", "2.20.13",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS serial, true AS stamped FROM orders",
)
def audit_stamps(t):
    out = dml.audit_columns(t.orders.select("o_orderkey"), "changed_at", "changed_by", "serial", ["o_orderkey"])
    return out.select("o_orderkey", "serial", (F.col("changed_at").isNotNull() & F.col("changed_by").isNotNull()).alias("stamped"))


@query("create_table_as", "2.1.15 2.20.14", "SELECT c_mktsegment, count(*) AS n, 0 AS extra FROM customer GROUP BY 1")
def create_table_as(t):
    base = scratch_path(t.spark, "ctas")
    t.customer.write.parquet(base)
    stored = t.spark.read.schema(t.customer.schema).parquet(base)
    return stored.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("extra", F.lit(0))


@query(
    "cluster_and_compact", "2.20.15 2.20.16",
    "SELECT 'rows' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'disorder', 0 UNION ALL SELECT 'files', 1",
)
def cluster_and_compact(t):
    base = scratch_path(t.spark, "cluster")
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    dml.clustered(t.lineitem, ["l_shipdate"], tie, 16).write.parquet(base)
    stored = t.spark.read.parquet(base)
    # files in range order: each starts where the one before it ended
    edges = stored.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))
    mixed = ordered.running(edges, [], ["f"], {"top": ("max", "hi")}, inclusive=False).filter("top > lo")
    packed = base + "-packed"
    dml.compacted(stored).write.parquet(packed)
    tally = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    # one file holds up to five million rows, so the expected number is one at test size
    files = t.spark.read.parquet(packed).select("_metadata.file_name").distinct()
    return tally("rows", stored).unionByName(tally("disorder", mixed)).unionByName(tally("files", files))


@query("partition_exclusion", "2.20.17", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def partition_exclusion(t):
    base = scratch_path(t.spark, "partitioned")
    t.orders.write.partitionBy("o_orderstatus").parquet(base)
    return t.spark.read.parquet(base).filter("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(
    "views", "2.20.9 2.8.4",
    "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 100000 GROUP BY 1",
)
def views(t):
    # names of their own, so that two runs in one session do not meet
    inner, outer = (f"tw_{kind}_{uuid.uuid4().hex}" for kind in ("open_orders", "big_open_orders"))
    t.orders.filter("o_orderstatus = 'O'").createOrReplaceTempView(inner)
    t.spark.sql(f"CREATE TEMPORARY VIEW {outer} AS SELECT * FROM {inner} WHERE o_totalprice > 100000")
    return t.spark.sql(f"SELECT o_custkey, count(*) AS n FROM {outer} GROUP BY o_custkey")


@query(
    "view_recursive", "2.20.9 2.8.4",
    """
    WITH RECURSIVE turns AS (SELECT DISTINCT c_nationkey AS start, c_nationkey AS k, 0 AS depth FROM customer
      UNION ALL SELECT start, k // 2, depth + 1 FROM turns WHERE k > 0)
    SELECT k, count(*) AS customers, max(depth)::INTEGER AS depth FROM turns JOIN customer ON c_nationkey = start GROUP BY k
    """,
)
def view_recursive(t):
    # a view whose definition is recursive, over the closed set of nation keys, and joined with all customers
    name = f"tw_turns_{uuid.uuid4().hex}"
    t.spark.sql(
        f"""CREATE TEMPORARY VIEW {name} AS
        WITH RECURSIVE turns AS (SELECT start, start AS k, 0 AS depth FROM (SELECT DISTINCT c_nationkey AS start FROM parquet.`{t.path("customer")}`)
          UNION ALL SELECT start, CAST(k DIV 2 AS INT), depth + 1 FROM turns WHERE k > 0)
        SELECT * FROM turns"""
    )
    return t.sql(f"SELECT k, count(*) AS customers, max(depth) AS depth FROM {name} JOIN {{customer}} ON c_nationkey = start GROUP BY k")


@query(
    "view_updatable", "2.20.9",
    """
    WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderstatus = 'O' AND o_totalprice > 100000 AS seen FROM orders),
    u AS (SELECT o_orderkey, CASE WHEN seen AND o_orderkey % 3 = 0 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
                 CASE WHEN seen AND o_orderkey % 3 = 0 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice, seen AND o_orderkey % 3 = 0 AS w FROM o),
    d AS (SELECT * FROM u WHERE NOT coalesce(o_orderstatus = 'O' AND o_totalprice > 100000 AND o_orderkey % 5 = 0, false)),
    i AS (SELECT -o_orderkey, NULL, o_totalprice FROM o WHERE seen AND o_orderkey % 7 = 0)
    SELECT 'table' AS what, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS low
    FROM (SELECT o_orderkey, o_orderstatus, o_totalprice FROM d UNION ALL SELECT * FROM i) GROUP BY 2
    UNION ALL SELECT 'written', 'P', count(*), round(sum(o_totalprice), 2), min(o_orderkey) FROM u WHERE w
    """,
)
def view_updatable(t):
    # a view of a view: an update that takes rows out of sight, a deletion, and rows added with a NULL status
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")

    def big_open(table):
        named = View(table, F.col("o_orderstatus") == "O", {"k": "o_orderkey", "price": "o_totalprice", "status": "o_orderstatus"})
        return View(named, F.col("price") > 100000)

    updated = big_open(orders).update({"status": F.lit("P"), "price": F.col("price") + 1000}, F.col("k") % 3 == 0)
    left = big_open(updated.table).delete(F.col("k") % 5 == 0)
    rows = big_open(orders).rows().filter("k % 7 = 0").select((-F.col("k")).alias("k"), "price")
    table = big_open(left.table).insert(rows).table
    tally = lambda what, df: df.toDF("k", "status", "price").groupBy(F.lit(what).alias("what"), F.col("status").alias("o_orderstatus")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("total"), F.min("k").alias("low")
    )
    return tally("table", table).unionByName(tally("written", updated.returning.select("k", "status", "price")))


@query(
    "snapshot_diff", "2.23.2",
    """
    SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'D' ELSE 'U' END AS op, '"customer",' || CASE WHEN c_custkey % 10 = 0 THEN 'D' ELSE 'U' END || ',"c_custkey"=''' || c_custkey || '''' AS payload
    FROM customer WHERE c_custkey % 10 = 0 OR c_acctbal < 0
    """,
)
def snapshot_diff(t):
    old = t.customer
    new = old.filter("c_custkey % 10 <> 0").withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return dml.notifications(dml.diff(old, new, ["c_custkey"]), "customer", ["c_custkey"])
