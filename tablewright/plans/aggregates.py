"""Grouping, aggregate functions, ordered-set and hypothetical-set aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import aggregates as agg
from tablewright.operators import ordered
from tablewright.plans.registry import query


@query(
    "pricing_summary", "2.4.1 2.4.2 2.2.1 2.2.2 2.1.1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
           round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
    """,
)
def pricing_summary(t):
    return (
        t.lineitem.filter("l_shipdate <= timestamp_ntz'2000-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("sum_disc_price"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


@query("group_without_aggregates", "2.4.3", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2")
def group_without_aggregates(t):
    return t.lineitem.filter("l_quantity > 40").select("l_partkey", "l_suppkey").distinct()


@query(
    "having", "2.4.4",
    """
    SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 30000
    UNION ALL SELECT -1, count(*) FROM orders HAVING max(o_totalprice) > 0
    """,
)
def having(t):
    return t.sql(
        """
        SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND min(o_totalprice) < 30000
        UNION ALL SELECT -1L, count(*) FROM {orders} HAVING max(o_totalprice) > 0
        """
    )


@query(
    "grouping_sets", "2.4.5 2.4.8",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS mask,
           count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), (l_linestatus, l_linenumber), ())
    """,
)
def grouping_sets(t):
    return t.sql(
        """
        SELECT l_returnflag, l_linestatus, l_linenumber, grouping_id(l_returnflag, l_linestatus, l_linenumber) AS mask,
               count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS qty
        FROM {lineitem}
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), GROUPING SETS ((l_linenumber), (l_linestatus, l_linenumber)), ())
        """
    )


@query(
    "rollup_cube", "2.4.6",
    """
    SELECT 'rollup' AS kind, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    UNION ALL
    SELECT 'cube', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
    UNION ALL
    SELECT 'composite', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), ())
    """,
)
def rollup_cube(t):
    n = F.count(F.lit(1)).alias("n")
    keys = ["o_orderstatus", "o_orderpriority"]
    kind = lambda k, df: df.select(F.lit(k).alias("kind"), *keys, "n")
    both = t.sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP ((o_orderstatus, o_orderpriority))")
    return kind("rollup", t.orders.rollup(*keys).agg(n)).union(kind("cube", t.orders.cube(*keys).agg(n))).union(kind("composite", both))


@query(
    "grouping_cross_product", "2.4.7",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem
    GROUP BY ROLLUP (l_returnflag, l_linestatus), GROUPING SETS ((l_linenumber), ())
    """,
)
def grouping_cross_product(t):
    return t.sql(
        """
        SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {lineitem}
        GROUP BY ROLLUP (l_returnflag, l_linestatus), GROUPING SETS ((l_linenumber), ())
        """
    )


@query(
    "group_by_primary_key", "2.4.9",
    """
    SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS n
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    """,
)
def group_by_primary_key(t):
    return agg.group_by_key(
        t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left"), ["c_custkey"],
        ["c_name", "c_mktsegment"], F.count("o_orderkey").alias("n"),
    )


@query(
    "distinct_aggregates", "2.4.10",
    """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps,
           CAST(sum(DISTINCT CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem GROUP BY 1
    """,
)
def distinct_aggregates(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("supps"),
        F.sum_distinct(F.col("l_quantity").cast("long")).alias("qty"),
    )


@query(
    "aggregate_filter", "2.4.11",
    """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
           max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open_max FROM orders GROUP BY 1
    """,
)
def aggregate_filter(t):
    return t.sql(
        """
        SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
               max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS open_max FROM {orders} GROUP BY 1
        """
    )


@query(
    "ordered_aggregates", "2.4.12 2.4.24 2.4.26",
    """
    WITH m AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, string_agg(p, ',' ORDER BY n DESC, p) AS by_count,
           array_to_string(array_agg(p ORDER BY p DESC), '|') AS backwards,
           array_to_string(array_agg(coalesce(CASE WHEN n > 1 THEN n END::VARCHAR, 'null') ORDER BY p), ',') AS with_nulls
    FROM m GROUP BY 1
    """,
)
def ordered_aggregates(t):
    # collected values come from a closed domain: at most five priorities a customer
    m = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    many = F.when(F.col("n") > 1, F.col("n"))
    return m.groupBy("o_custkey").agg(
        F.array_join(agg.array_agg(F.col("p"), ["-n", "p"]), ",").alias("by_count"),
        F.array_join(agg.array_agg(F.col("p"), ["-p"]), "|").alias("backwards"),
        F.array_join(agg.array_agg(many, ["p"]), ",", "null").alias("with_nulls"),
    )


@query(
    "basic_aggregates", "2.4.13 2.4.14 2.4.15 2.4.16 2.4.18",
    """
    SELECT event_type, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS n_big,
           round(avg(value), 6) AS mean, round(sum(value), 2) AS total,
           max(value) AS hi, min(value) AS lo, max(props) AS last_text, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts,
           CAST(max([user_id, event_id])[2] AS BIGINT) AS max_pair
    FROM events GROUP BY 1
    """,
)
def basic_aggregates(t):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("n_big"),
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 2).alias("total"),
        F.max("value").alias("hi"), F.min("value").alias("lo"), F.max("props").alias("last_text"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        F.max(F.array("user_id", "event_id"))[1].alias("max_pair"),
    )


@query(
    "interval_aggregates", "2.4.17 2.10.3",
    """
    SELECT l_returnflag, CAST(sum(date_diff('day', o_orderdate, l_shipdate)) AS BIGINT) AS days,
           CAST(floor(avg(date_diff('day', o_orderdate, l_shipdate)) * 86400) AS BIGINT) AS mean_seconds
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """,
)
def interval_aggregates(t):
    wait = (F.col("l_shipdate") - F.col("o_orderdate")).alias("wait")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_returnflag", wait)
    totals = rows.groupBy("l_returnflag").agg(agg.interval_sum(F.col("wait")).alias("total"), agg.interval_avg(F.col("wait")).alias("mean"))
    return totals.select(
        "l_returnflag", F.expr("total div 86400000000").cast("long").alias("days"), F.floor(F.col("mean") / 1_000_000).cast("long").alias("mean_seconds"),
    )


@query(
    "variance_family", "2.4.19",
    """
    SELECT event_type, round(var_pop(value), 4) AS var_pop, round(var_samp(value), 4) AS var_samp,
           round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp FROM events GROUP BY 1
    """,
)
def variance_family(t):
    return t.events.groupBy("event_type").agg(
        F.round(F.var_pop("value"), 4).alias("var_pop"), F.round(F.var_samp("value"), 4).alias("var_samp"),
        F.round(F.stddev_pop("value"), 6).alias("sd_pop"), F.round(F.stddev_samp("value"), 6).alias("sd_samp"),
    )


REGR = ["regr_avgx", "regr_avgy", "regr_r2", "regr_slope", "regr_intercept"]


@query(
    "regression_family", "2.4.20 2.4.21",
    "SELECT l_returnflag, "
    + ", ".join(f"round({f}(l_extendedprice, l_quantity), 5) AS {f}" for f in REGR)
    + """, regr_count(l_extendedprice, l_quantity)::BIGINT AS regr_count,
      round(regr_sxx(l_extendedprice, l_quantity) / 1000, 3) AS regr_sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000000, 3) AS regr_sxy,
      round(regr_syy(l_extendedprice, l_quantity) / 1000000000, 3) AS regr_syy,
      round(covar_pop(l_extendedprice, l_quantity), 3) AS covar_pop, round(covar_samp(l_extendedprice, l_quantity), 3) AS covar_samp,
      round(corr(l_extendedprice, l_quantity), 7) AS corr FROM lineitem GROUP BY 1""",
)
def regression_family(t):
    y, x = "l_extendedprice", "l_quantity"
    fns = [F.round(getattr(F, f)(y, x), 5).alias(f) for f in REGR]
    scaled = {"regr_sxx": 1e3, "regr_sxy": 1e6, "regr_syy": 1e9}
    return t.lineitem.groupBy("l_returnflag").agg(
        *fns, F.regr_count(y, x).alias("regr_count"),
        *[F.round(getattr(F, f)(y, x) / s, 3).alias(f) for f, s in scaled.items()],
        F.round(F.covar_pop(y, x), 3).alias("covar_pop"), F.round(F.covar_samp(y, x), 3).alias("covar_samp"),
        F.round(F.corr(y, x), 7).alias("corr"),
    )


@query(
    "boolean_bit_aggregates", "2.4.22 2.4.23",
    """
    SELECT o_custkey, bool_and(o_totalprice > 10000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p,
           bool_and(o_orderkey >= 0) AS every_ok, bit_and(o_orderkey + 1024) AS b_and, bit_or(o_orderkey) AS b_or FROM orders GROUP BY 1
    """,
)
def boolean_bit_aggregates(t):
    return t.orders.groupBy("o_custkey").agg(
        F.bool_and(F.col("o_totalprice") > 10000).alias("all_big"), F.bool_or(F.col("o_orderstatus") == "P").alias("any_p"),
        F.every(F.col("o_orderkey") >= 0).alias("every_ok"), F.bit_and(F.col("o_orderkey") + 1024).alias("b_and"),
        F.bit_or("o_orderkey").alias("b_or"),
    )


@query(
    "array_agg_nested", "2.4.25 2.4.35",
    """
    WITH m AS (SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_regionkey, to_json(array_agg([n_nationkey::BIGINT, n] ORDER BY n_nationkey))::VARCHAR AS pairs,
           CAST(sum(n_nationkey) AS BIGINT) AS key_sum FROM m GROUP BY 1
    """,
)
def array_agg_nested(t):
    m = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))
    pair = F.array(F.col("n_nationkey").cast("long"), F.col("n"))
    out = m.groupBy("n_regionkey").agg(agg.array_agg(pair, ["n_nationkey"]).alias("a"))
    return out.select(
        "n_regionkey", F.to_json("a").alias("pairs"), F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x[0]).alias("key_sum")
    )


@query(
    "json_aggregates", "2.4.27 2.4.28",
    """
    WITH m AS (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, '[' || string_agg('{"k":"' || k || '","n":' || n || '}', ',' ORDER BY k) || ']' AS arr,
           '{' || string_agg('"' || k || '":' || coalesce(CASE WHEN n > 10 THEN n END::VARCHAR, 'null'), ',' ORDER BY k) || '}' AS obj
    FROM m GROUP BY 1
    """,
)
def json_aggregates(t):
    m = t.events.groupBy("user_id", F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return m.groupBy("user_id").agg(
        agg.json_agg(F.struct("k", "n"), ["k"]).alias("arr"),
        agg.json_object_agg(F.col("k"), F.when(F.col("n") > 10, F.col("n"))).alias("obj"),
    )


@query(
    "xml_aggregate", "2.4.29",
    """
    SELECT c_nationkey, string_agg('<seg n="' || n || '">' || c_mktsegment || '</seg>', '' ORDER BY c_mktsegment) AS xml
    FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1
    """,
)
def xml_aggregate(t):
    m = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    piece = F.format_string('<seg n="%s">%s</seg>', "n", "c_mktsegment")
    return m.groupBy("c_nationkey").agg(F.array_join(agg.array_agg(piece, ["c_mktsegment"]), "").alias("xml"))


@query(
    "percentiles_continuous", "2.4.30 2.4.32",
    """
    SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.9), 4) AS p90,
           round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY 1
    """,
)
def percentiles_continuous(t):
    out = ordered.exact_percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("o_orderpriority", *[F.round(p, 4).alias(p) for p in ("p50", "p90", "p99")])


@query(
    "percentiles_discrete", "2.4.31",
    """
    SELECT c_nationkey, max(CASE WHEN rn = ceil(0.25 * n) THEN c_mktsegment END) AS q1, max(CASE WHEN rn = ceil(0.5 * n) THEN c_mktsegment END) AS mid
    FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS rn,
                 count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) GROUP BY 1
    """,
)
def percentiles_discrete(t):
    return ordered.exact_percentiles(t.customer, ["c_nationkey"], "c_mktsegment", {"q1": 0.25, "mid": 0.5}, "disc")


@query(
    "mode_value", "2.4.33",
    """
    SELECT l_suppkey, l_linenumber AS top FROM (
      SELECT l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS r
      FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1
    """,
)
def mode_value(t):
    return ordered.modes(t.lineitem, ["l_suppkey"], "l_linenumber", "top")


@query(
    "hypothetical_set", "2.4.34",
    """
    SELECT o_orderpriority, 1 + count(*) FILTER (WHERE o_totalprice < 150000) AS rank,
           1 + count(DISTINCT CASE WHEN o_totalprice < 150000 THEN o_totalprice END) AS dense_rank,
           round(count(*) FILTER (WHERE o_totalprice < 150000) / count(*), 9) AS percent_rank,
           round((1 + count(*) FILTER (WHERE o_totalprice <= 150000)) / (count(*) + 1), 9) AS cume_dist FROM orders GROUP BY 1
    """,
)
def hypothetical_set(t):
    h = agg.hypothetical(F.col("o_totalprice"), F.lit(150000.0))
    return t.orders.groupBy("o_orderpriority").agg(
        h["rank"].alias("rank"), h["dense_rank"].alias("dense_rank"),
        F.round(h["percent_rank"], 9).alias("percent_rank"), F.round(h["cume_dist"], 9).alias("cume_dist"),
    )


@query(
    "user_defined_aggregates", "2.24.5 2.24.6 2.24.7",
    """
    SELECT l_suppkey, round(exp(avg(ln(l_extendedprice))), 4) AS geo_mean, min(least(l_partkey, l_orderkey)) AS least_any,
           CAST(sum(l_linenumber + l_partkey) AS BIGINT) AS sum2,
           max(CASE WHEN l_discount = 0.05 THEN l_quantity END) AS picked FROM lineitem GROUP BY 1
    """,
)
def user_defined_aggregates(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(agg.geometric_mean(F.col("l_extendedprice")), 4).alias("geo_mean"),
        agg.least_of("l_partkey", "l_orderkey").alias("least_any"),
        F.sum(F.col("l_linenumber") + F.col("l_partkey")).alias("sum2"),
        F.max(F.when(F.col("l_discount") == 0.05, F.col("l_quantity"))).alias("picked"),
    )
