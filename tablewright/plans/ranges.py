"""Range types over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import ranges as rg
from tablewright.operators import intervals
from tablewright.plans.joins import SPANS_SQL, busy_spans
from tablewright.plans.registry import query

NUMS = "(SELECT o_orderkey AS k, o_orderkey % 40 AS a0, o_orderkey % 40 + o_custkey % 15 AS a1, o_custkey % 40 AS b0, o_custkey % 40 + o_orderkey % 11 AS b1 FROM orders)"


def two(t):
    """Two integer ranges a and b per order, half open."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a = rg.make(k % 40, k % 40 + c % 15)
    b = rg.make(c % 40, c % 40 + k % 11)
    return t.spread("orders", "o_orderkey").select(k.alias("k"), a.alias("a"), b.alias("b"))


@query(
    "range_construction", "2.14.1 2.14.2 2.14.3 2.14.15 2.14.16",
    f"""
    SELECT k, CASE WHEN a0 = a1 THEN 'empty' ELSE '[' || a0 || ',' || a1 || ')' END AS txt, '[' || a0 || ',' || (a1 + 1) || ')' AS closed,
           CASE WHEN a0 + 1 >= a1 THEN 'empty' ELSE '[' || (a0 + 1) || ',' || a1 || ')' END AS open_, '[' || a0 || ',)' AS half,
           CASE WHEN a0 < a1 THEN a0 END AS lo, CASE WHEN a0 < a1 THEN a1 END AS hi, a0 = a1 AS void, a0 < a1 AS li, false AS ui, false AS linf, true AS uinf,
           CASE WHEN a0 < a1 THEN a1 - a0 END AS len FROM {NUMS}
    """,
)
def range_construction(t):
    src = two(t)
    k, a = F.col("k"), F.col("a")
    orders = t.orders.select("o_orderkey", (F.col("o_orderkey") % 40).alias("a0"), (F.col("o_orderkey") % 40 + F.col("o_custkey") % 15).alias("a1"))
    lo, hi = F.col("a0"), F.col("a1")
    one = F.lit(1)
    forms = orders.select(
        F.col("o_orderkey").alias("k"), rg.text(rg.make(lo, hi, "[]", one)).alias("closed"),
        # the open form is built only where its bounds stay in order
        rg.text(F.when(lo < hi, rg.make(lo, F.greatest(hi, lo + 1), "()", one)).otherwise(rg.make(lo, lo))).alias("open_"),
        rg.text(rg.make(lo, F.lit(None).cast("long"))).alias("half"), rg.upper_inf(rg.make(lo, F.lit(None).cast("long"))).alias("uinf"),
    )
    return src.select(
        k, rg.text(a).alias("txt"), rg.lower(a).alias("lo"), rg.upper(a).alias("hi"), rg.is_empty(a).alias("void"), a["lower_inc"].alias("li"),
        a["upper_inc"].alias("ui"), rg.lower_inf(a).alias("linf"), rg.length(a).alias("len"),
    ).join(forms, "k")


@query(
    "range_predicates", "2.14.4 2.14.5 2.14.6 2.14.7 2.14.8 2.14.9",
    f"""
    WITH r AS (SELECT *, a0 < a1 AS ok_a, b0 < b1 AS ok_b FROM {NUMS})
    SELECT k, ok_a AND 12 >= a0 AND 12 < a1 AS has12, NOT ok_b OR (ok_a AND a0 <= b0 AND b1 <= a1) AS con, NOT ok_a OR (ok_b AND b0 <= a0 AND a1 <= b1) AS inside,
           ok_a AND ok_b AND a0 < b1 AND b0 < a1 AS ov, ok_a AND ok_b AND a1 <= b0 AS lf, ok_a AND ok_b AND b1 <= a0 AS rt,
           ok_a AND ok_b AND a1 <= b1 AS nr, ok_a AND ok_b AND a0 >= b0 AS nl, ok_a AND ok_b AND (a1 = b0 OR b1 = a0) AS adj FROM r
    """,
)
def range_predicates(t):
    a, b = F.col("a"), F.col("b")
    return two(t).select(
        "k", rg.contains_element(a, F.lit(12)).alias("has12"), rg.contains(a, b).alias("con"), rg.contained_by(a, b).alias("inside"), rg.overlaps(a, b).alias("ov"),
        rg.left_of(a, b).alias("lf"), rg.right_of(a, b).alias("rt"), rg.not_right_of(a, b).alias("nr"), rg.not_left_of(a, b).alias("nl"), rg.adjacent(a, b).alias("adj"),
    )


@query(
    "range_set_operations", "2.14.10 2.14.11 2.14.12 2.14.13",
    f"""
    WITH r AS (SELECT *, a0 < a1 AS ok_a, b0 < b1 AS ok_b FROM {NUMS}), s AS (SELECT *, ok_a AND ok_b AND a0 < b1 AND b0 < a1 AS ov FROM r)
    SELECT k, CASE WHEN NOT ok_a AND NOT ok_b THEN 'empty' WHEN NOT ok_a THEN '[' || b0 || ',' || b1 || ')' WHEN NOT ok_b THEN '[' || a0 || ',' || a1 || ')'
                ELSE '[' || least(a0, b0) || ',' || greatest(a1, b1) || ')' END AS merged,
           CASE WHEN ov THEN '[' || greatest(a0, b0) || ',' || least(a1, b1) || ')' ELSE 'empty' END AS isect,
           CASE WHEN NOT ok_a OR NOT ok_b OR ov OR a1 = b0 OR b1 = a0 THEN 'joined' ELSE 'apart' END AS uni,
           CASE WHEN NOT ok_a THEN 'empty' WHEN NOT ov THEN '[' || a0 || ',' || a1 || ')' WHEN a0 < b0 AND b1 < a1 THEN 'split'
                WHEN a0 < b0 THEN '[' || a0 || ',' || b0 || ')' WHEN b1 < a1 THEN '[' || b1 || ',' || a1 || ')' ELSE 'empty' END AS diff
    FROM s
    """,
)
def range_set_operations(t):
    a, b = F.col("a"), F.col("b")
    joined = rg.is_empty(a) | rg.is_empty(b) | rg.overlaps(a, b) | rg.adjacent(a, b)
    split = rg.overlaps(a, b) & (a["lower"] < b["lower"]) & (b["upper"] < a["upper"])
    uni = F.when(joined & (rg.text(rg.union(a, b)) == rg.text(rg.merge(a, b))), "joined").otherwise("apart")
    return two(t).select(
        "k", rg.text(rg.merge(a, b)).alias("merged"), rg.text(rg.intersect(a, b)).alias("isect"), uni.alias("uni"),
        F.when(split, F.lit("split")).otherwise(rg.text(rg.minus(a, b))).alias("diff"),
    )


@query(
    "range_order", "2.14.14",
    f"""
    SELECT k, (row_number() OVER (ORDER BY (a0 < a1), CASE WHEN a0 < a1 THEN a0 END, CASE WHEN a0 < a1 THEN a1 END, k))::INTEGER AS place FROM {NUMS}
    """,
)
def range_order(t):
    from tablewright.operators import ordered

    keyed = two(t).select("k", rg.sort_key(F.col("a")).alias("s")).select("k", F.col("s.a").alias("s1"), F.col("s.c").alias("s2"), F.col("s.f").alias("s3"))
    return ordered.number_rows(keyed, [], ["s1", "s2", "s3", "k"], "place").select("k", F.col("place").cast("int").alias("place"))


@query(
    "exclusion_conflicts", "2.14.17",
    f"""
    WITH s AS ({SPANS_SQL}) SELECT span_id FROM (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s WHERE lo < hi)
    WHERE reach > lo
    """,
)
def exclusion_conflicts(t):
    return intervals.exclusion_conflicts(busy_spans(t), ["user_id"], "lo", "hi", "span_id").select("span_id")


ISLANDS = f"""
    WITH s AS (SELECT DISTINCT user_id, lo, hi FROM ({SPANS_SQL}) WHERE lo < hi),
    m AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
"""


@query(
    "interval_packing", "2.14.18",
    ISLANDS + """
    SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS parts FROM (
      SELECT *, sum(CASE WHEN reach IS NULL OR reach < lo THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi) AS island FROM m) GROUP BY user_id, island
    """,
)
def interval_packing(t):
    return intervals.pack(busy_spans(t), ["user_id"], "lo", "hi")


@query("interval_gaps", "2.14.18", ISLANDS + "SELECT user_id, reach AS gap_from, lo AS gap_to FROM m WHERE reach < lo")
def interval_gaps(t):
    return intervals.gaps(busy_spans(t), ["user_id"], "lo", "hi")
