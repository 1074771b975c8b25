"""Subqueries, common table expressions, recursion, pivots, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import pivots, recursion, relational
from tablewright.plans.registry import query
from tablewright.session import scratch_path


@query(
    "scalar_subqueries", "2.8.1 2.1.7",
    """
    SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 9) AS share FROM orders
    WHERE o_totalprice > (SELECT avg(o.o_totalprice) * 1.5 FROM orders o WHERE o.o_custkey = orders.o_custkey)
    """,
)
def scalar_subqueries(t):
    return t.sql(
        """
        SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM {orders}), 9) AS share FROM {orders} x
        WHERE o_totalprice > (SELECT avg(o.o_totalprice) * 1.5 FROM {orders} o WHERE o.o_custkey = x.o_custkey)
        """
    )


@query(
    "array_subquery", "2.8.2",
    """
    SELECT r_regionkey, r_name, array_to_string(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name), ',') AS nations,
           (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers FROM region
    """,
)
def array_subquery(t):
    return t.sql(
        """
        SELECT r_regionkey, r_name,
               array_join((SELECT sort_array(collect_list(n_name)) FROM {nation} WHERE n_regionkey = r_regionkey), ',') AS nations,
               (SELECT count(*) FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) AS customers
        FROM {region}
        """
    )


@query(
    "common_table_expression", "2.8.3",
    """
    WITH rev AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY 1)
    SELECT s_suppkey, s_name, total FROM supplier JOIN rev ON s_suppkey = l_suppkey WHERE total > (SELECT avg(total) FROM rev)
    """,
)
def common_table_expression(t):
    return t.sql(
        """
        WITH rev AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM {lineitem} GROUP BY 1)
        SELECT s_suppkey, s_name, total FROM {supplier} JOIN rev ON s_suppkey = l_suppkey WHERE total > (SELECT avg(total) FROM rev)
        """
    )


@query(
    "recursive_union_all", "2.8.4",
    """
    WITH RECURSIVE r AS (
      SELECT p_partkey AS root, p_partkey AS k, 0 AS depth FROM part
      UNION ALL SELECT root, k // 2, depth + 1 FROM r WHERE k > 0)
    SELECT k, count(*) AS n, max(depth)::INTEGER AS depth FROM r GROUP BY k
    """,
)
def recursive_union_all(t):
    # walks up a binary numbering of the parts: depth grows with the log of the table
    seed = t.part.select(F.col("p_partkey").alias("root"), F.col("p_partkey").alias("k"), F.lit(0).alias("depth"))
    step = lambda r: r.filter("k > 0").select("root", F.expr("k div 2").alias("k"), (F.col("depth") + 1).alias("depth"))
    return recursion.fixpoint(seed, step, distinct=False).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))


@query(
    "recursive_cte_sql", "2.8.4",
    """
    WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_regionkey AS g, 1 AS step FROM nation
      UNION ALL SELECT k + 5, g, step + 1 FROM r WHERE k + 5 < 25)
    SELECT g, count(*) AS n, max(step)::INTEGER AS steps, count(c_custkey) AS customers FROM r LEFT JOIN customer ON c_nationkey = k GROUP BY g
    """,
)
def recursive_cte_sql(t):
    return t.sql(
        """
        WITH RECURSIVE r AS (SELECT n_nationkey AS k, n_regionkey AS g, 1 AS step FROM {nation}
          UNION ALL SELECT k + 5, g, step + 1 FROM r WHERE k + 5 < 25)
        SELECT g, count(*) AS n, max(step) AS steps, count(c_custkey) AS customers FROM r LEFT JOIN {customer} ON c_nationkey = k GROUP BY g
        """
    )


@query(
    "recursive_reachable", "2.8.5",
    """
    WITH RECURSIVE edge AS (
      SELECT DISTINCT o_custkey * 4 AS f, l_partkey * 4 + 1 AS t FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      UNION ALL SELECT DISTINCT l_partkey * 4 + 1, l_suppkey * 4 + 2 FROM lineitem
      UNION ALL SELECT s_suppkey * 4 + 2, s_nationkey::BIGINT * 4 + 3 FROM supplier
      UNION ALL SELECT c_nationkey::BIGINT * 4 + 3, c_custkey * 4 FROM customer),
    r AS (SELECT c_custkey * 4 AS start, c_custkey * 4 AS node FROM customer WHERE c_custkey IN (SELECT min(c_custkey) FROM customer UNION ALL SELECT max(c_custkey) FROM customer)
      UNION SELECT r.start, e.t FROM r JOIN edge e ON e.f = r.node)
    SELECT start, node FROM r
    """,
)
def recursive_reachable(t):
    # customers, the parts they ordered, the suppliers of those, the customers of the suppliers' nations, and so on
    link = lambda df, f, kind, to, to_kind: df.select((F.col(f).cast("long") * 4 + kind).alias("f"), (F.col(to).cast("long") * 4 + to_kind).alias("t"))
    ordered_parts = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    edges = (
        link(ordered_parts, "o_custkey", 0, "l_partkey", 1).distinct().unionAll(link(t.lineitem, "l_partkey", 1, "l_suppkey", 2).distinct())
        .unionAll(link(t.supplier, "s_suppkey", 2, "s_nationkey", 3)).unionAll(link(t.customer, "c_nationkey", 3, "c_custkey", 0))
    )
    path = scratch_path(t.spark, "edges")
    edges.write.parquet(path)
    edges = t.spark.read.parquet(path)
    ends = t.customer.agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).select(F.explode(F.array("a", "b")).alias("k"))
    seed = ends.select((F.col("k") * 4).alias("start"), (F.col("k") * 4).alias("node"))
    return recursion.fixpoint(seed, lambda r: r.join(edges, F.col("node") == F.col("f")).select("start", F.col("t").alias("node")))


@query(
    "recursive_paths", "2.8.6",
    """
    WITH RECURSIVE e AS (SELECT conv_id, turn AS f, (turn + 1) % (max(turn) OVER (PARTITION BY conv_id) + 1) AS t FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
    r AS (SELECT conv_id, f, t, [f, t] AS path, f = t AS cycle FROM e WHERE f = 0
      UNION ALL SELECT r.conv_id, e.f, e.t, list_append(path, e.t), list_contains(path, e.t) FROM r JOIN e ON e.conv_id = r.conv_id AND e.f = r.t WHERE NOT cycle)
    SELECT conv_id, f, t, array_to_string(path, '>') AS path, cycle FROM r
    """,
)
def recursive_paths(t):
    # the last turn of a conversation leads back to its first
    turns = t.conversations.select("conv_id", "turn").distinct()
    last = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    e = turns.join(last, "conv_id").select("conv_id", F.col("turn").alias("f"), ((F.col("turn") + 1) % F.col("n")).alias("t"))
    path = scratch_path(t.spark, "turns")
    e.write.parquet(path)
    e = t.spark.read.parquet(path)
    seed = e.filter("f = 0").select("conv_id", "f", "t", F.array("f", "t").alias("path"), (F.col("f") == F.col("t")).alias("cycle"))
    nxt = e.select("conv_id", F.col("f").alias("f2"), F.col("t").alias("t2"))

    def step(r):
        return r.filter("not cycle").withColumnRenamed("t", "f2").drop("f").join(nxt, ["conv_id", "f2"]).select(
            "conv_id", F.col("f2").alias("f"), F.col("t2").alias("t"), F.array_append("path", F.col("t2")).alias("path"),
            F.array_contains("path", F.col("t2")).alias("cycle"),
        )

    return recursion.fixpoint(seed, step, distinct=False).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(
    "hierarchy_walk", "2.8.7",
    """
    WITH RECURSIVE t AS (SELECT c_custkey AS k, CASE WHEN c_custkey > 0 THEN (c_custkey - 1) // 4 END AS p FROM customer),
    r AS (SELECT k, NULL::BIGINT AS p, 0 AS level, k::VARCHAR AS branch FROM t WHERE p IS NULL
      UNION ALL SELECT t.k, t.p, level + 1, branch || '~' || t.k FROM r JOIN t ON t.p = r.k)
    SELECT k, p, level::INTEGER AS level, branch FROM r
    """,
)
def hierarchy_walk(t):
    tree = t.customer.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") > 0, F.expr("(c_custkey - 1) div 4")).alias("p"))
    return recursion.connect_by(tree, "k", "p", F.col("p").isNull())


@query(
    "set_returning_in_from", "2.8.11 2.9.28",
    """
    SELECT url, part, count(*) AS n FROM (SELECT page_id, url, unnest(regexp_split_to_array(regexp_replace(url, '^https?://', ''), '[./?=&#]+')) AS part FROM pages)
    WHERE part <> '' GROUP BY ALL
    """,
)
def set_returning_in_from(t):
    parts = F.split(F.regexp_replace("url", "^https?://", ""), "[./?=&#]+")
    return t.pages.select("url", F.explode(parts).alias("part")).filter("part <> ''").groupBy("url", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "crosstab_categories", "2.8.12 2.8.13",
    """
    SELECT o_custkey, max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS "1-URGENT",
           max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH') AS "2-HIGH", max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS "5-LOW"
    FROM orders GROUP BY 1
    """,
)
def crosstab_categories(t):
    top = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.max("o_totalprice").alias("v"))
    return pivots.crosstab_by_category(top, "o_custkey", "o_orderpriority", "v", ["1-URGENT", "2-HIGH", "5-LOW"])


@query(
    "crosstab_positions", "2.8.12",
    """
    SELECT o_custkey, max(CASE WHEN r = 1 THEN o_totalprice END) AS category_1, max(CASE WHEN r = 2 THEN o_totalprice END) AS category_2,
           max(CASE WHEN r = 3 THEN o_totalprice END) AS category_3
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1
    """,
)
def crosstab_positions(t):
    return pivots.crosstab_by_position(t.orders, "o_custkey", ["o_orderkey"], "o_totalprice", 3)


@query("normal_rand", "2.8.14")
def normal_rand(t):
    # one gaussian draw per order; only the moments are reported
    draws = t.orders.select((F.randn(5) * 2.0 + 10.0).alias("x"))
    return draws.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 0).alias("mean"), F.round(F.stddev_pop("x"), 0).alias("sd"))


@query(
    "sequence_keys", "2.8.15",
    "SELECT o_orderkey, 1000 + 5 * (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) AS nextval FROM orders",
)
def sequence_keys(t):
    return relational.next_values(t.orders, ["o_orderdate", "o_orderkey"], 1000, 5).select("o_orderkey", "nextval")
