"""Array functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import arrays as ar
from tablewright.plans.registry import query

show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "null")
BASE = "(SELECT o_orderkey, [o_orderkey % 7, o_custkey % 5, o_orderkey % 5, o_custkey % 7]::BIGINT[] AS a, [o_custkey % 5, o_orderkey % 3]::BIGINT[] AS b FROM orders)"


def base(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", F.array(k % 7, c % 5, k % 5, c % 7).alias("a"), F.array(c % 5, k % 3).alias("b"))


@query(
    "array_building", "2.12.1 2.12.2 2.12.3 2.12.7 2.12.8 2.12.6",
    f"""
    SELECT o_orderkey, array_to_string(list_append(a, 99), ',') AS app, array_to_string(list_prepend(99, a), ',') AS pre,
           array_to_string(a || b, ',') AS cat, array_to_string(list_filter(a, lambda x: x <> 2), ',') AS rem,
           array_to_string(list_transform(a, lambda x: CASE WHEN x = 2 THEN 20 ELSE x END), ',') AS rep, '[[7,7],[7,7],[7,7]]' AS filled,
           array_to_string(list_append(a, 1) || a, ',') AS nested FROM {BASE}
    """,
)
def array_building(t):
    a, b = F.col("a"), F.col("b")
    return base(t).select(
        "o_orderkey", show(F.array_append(a, F.lit(99))).alias("app"), show(F.array_prepend(a, F.lit(99))).alias("pre"), show(F.concat(a, b)).alias("cat"),
        show(F.array_remove(a, 2)).alias("rem"), show(ar.replace(a, F.lit(2), F.lit(20).cast("long"))).alias("rep"),
        F.to_json(ar.fill(F.lit(7), 3, 2)).alias("filled"), show(F.flatten(F.array_append(F.array(F.array_append(a, F.lit(1))), a))).alias("nested"),
    )


@query(
    "array_search", "2.12.4 2.12.5 2.12.9 2.12.10 2.12.15",
    f"""
    SELECT o_orderkey, list_position(a, 2)::INTEGER AS pos,
           array_to_string([i FOR i IN range(1, 5) IF a[i] = 2], ',') AS all_pos, len(a)::INTEGER AS n, 1 AS lo, '[1:4]' AS dims, len(a || b)::INTEGER AS card,
           a[2] AS second, a[9] AS none, array_to_string(a[2:3], ',') AS mid, array_to_string([a[1], 77, a[3], a[4]], ',') AS put,
           array_to_string([coalesce(x::VARCHAR, 'null') FOR x IN a || [NULL, 5]], ',') AS grown
    FROM {BASE}
    """,
)
def array_search(t):
    a, b = F.col("a"), F.col("b")
    return base(t).select(
        "o_orderkey", ar.position(a, F.lit(2)).alias("pos"), show(ar.positions(a, F.lit(2))).alias("all_pos"), F.size(a).alias("n"), F.lit(1).alias("lo"),
        ar.dims_text(F.size(a)).alias("dims"), F.cardinality(F.flatten(F.array(a, b))).alias("card"), ar.subscript(a, F.lit(2)).alias("second"),
        ar.subscript(a, F.lit(9)).alias("none"), show(ar.part(a, F.lit(2), F.lit(3))).alias("mid"), show(ar.assign(a, 2, F.lit(77).cast("long"))).alias("put"),
        show(ar.assign(a, 6, F.lit(5).cast("long"))).alias("grown"),
    )


@query(
    "array_comparison", "2.12.11 2.12.12 2.12.13 2.12.14 2.12.18",
    f"""
    SELECT o_orderkey, list_has_all(a, b) AS con, list_has_all(b, a) AS con_by, list_has_any(a, b) AS ov, a = b AS eq, a < b AS lt, a >= b AS ge,
           list_contains(a, 1) AND (list_contains(a, 2) OR NOT list_contains(a, 3)) AS q FROM {BASE}
    """,
)
def array_comparison(t):
    a, b = F.col("a"), F.col("b")
    return base(t).select(
        "o_orderkey", ar.contains(a, b).alias("con"), ar.contains(b, a).alias("con_by"), ar.overlaps(a, b).alias("ov"), (a == b).alias("eq"),
        (a < b).alias("lt"), (a >= b).alias("ge"), ar.matches_query(a, "1 & (2 | !3)").alias("q"),
    )


@query(
    "array_text", "2.12.16",
    """
    SELECT page_id, array_to_string(list_transform(string_split(url, '/'), lambda x: CASE WHEN x = '' THEN 'NULL' ELSE x END), '+') AS joined,
           len(string_split(url, '/'))::INTEGER AS n FROM pages
    """,
)
def array_text(t):
    parts = ar.to_array(F.col("url"), "/", "")
    return t.pages.select("page_id", F.array_join(parts, "+", "NULL").alias("joined"), F.size(parts).alias("n"))


@query(
    "integer_array_algebra", "2.12.17 2.4.35",
    f"""
    SELECT o_orderkey, len(a)::INTEGER AS icount, array_to_string(list_sort(a), ',') AS asc_, array_to_string(list_reverse_sort(a), ',') AS desc_,
           array_to_string(list_sort(list_distinct(a)), ',') AS uniq, coalesce(list_position(a, 1), 0)::INTEGER AS idx,
           array_to_string(a[2:3], ',') AS sub, array_to_string(a[3:4], ',') AS tail,
           array_to_string(list_sort(list_distinct(a || b)), ',') AS uni, array_to_string(list_sort(list_intersect(a, b)), ',') AS isect,
           array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS minus FROM {BASE}
    """,
)
def integer_array_algebra(t):
    a, b = F.col("a"), F.col("b")
    return base(t).select(
        "o_orderkey", F.size(a).alias("icount"), show(F.sort_array(a)).alias("asc_"), show(F.sort_array(a, asc=False)).alias("desc_"),
        show(ar.uniq(F.sort_array(a))).alias("uniq"), F.coalesce(ar.position(a, F.lit(1)), F.lit(0)).alias("idx"), show(ar.subarray(a, 2, 2)).alias("sub"),
        show(ar.subarray(a, -2)).alias("tail"), show(ar.union_sorted(a, b)).alias("uni"), show(ar.intersect_sorted(a, b)).alias("isect"),
        show(ar.without(a, b)).alias("minus"),
    )
