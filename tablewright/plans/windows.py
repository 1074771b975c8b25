"""Window functions: ranks, offsets, frames, named windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import ordered
from tablewright.plans.registry import query


@query(
    "window_row_number_ntile", "2.5.1 2.5.6",
    """
    SELECT o_orderkey,
           row_number() OVER w AS rn,
           ntile(7) OVER w AS tile
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey)
    """,
)
def window_row_number_ntile(t):
    rows = ordered.number_rows(
        t.orders, ["o_orderstatus"], ["-o_totalprice", "o_orderkey"], "rn", total="cnt"
    )
    return rows.select("o_orderkey", "rn", ordered.ntile(F.col("rn"), F.col("cnt"), 7).alias("tile"))


@query(
    "window_rank_family", "2.5.2 2.5.3 2.5.4 2.5.5",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
           round(percent_rank() OVER w, 9) AS percent_rank,
           round(cume_dist() OVER w, 9) AS cume_dist
    FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity DESC)
    """,
)
def window_rank_family(t):
    return ordered.with_ranks(t.lineitem, ["l_returnflag"], ["-l_quantity"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rank", "dense_rank",
        F.round("percent_rank", 9).alias("percent_rank"), F.round("cume_dist", 9).alias("cume_dist"),
    )


@query(
    "window_lag_lead", "2.5.7 2.5.8",
    """
    SELECT event_id,
           lag(value) OVER w AS prev_value,
           lead(event_type, 2, 'none') OVER w AS next2,
           date_diff('microsecond', lag(ts) OVER w, ts) AS gap_us
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def window_lag_lead(t):
    out = ordered.sliding(
        t.events, ["user_id"], ["ts", "event_id"], 1, 2,
        {
            "prev_value": lambda w: F.lag("value").over(w),
            "next2": lambda w: F.lead("event_type", 2, "none").over(w),
            "prev_ts": lambda w: F.lag("ts").over(w),
        },
    )
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("event_id", "prev_value", "next2", (micros("ts") - micros("prev_ts")).alias("gap_us"))


@query(
    "window_lag_row_offset", "2.5.7",
    """
    WITH n AS (
      SELECT event_id, user_id, value, event_id % 4 AS off,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
      FROM events)
    SELECT a.event_id, CASE WHEN b.rn IS NULL THEN -1.0 ELSE b.value END AS earlier
    FROM n a LEFT JOIN n b ON a.user_id = b.user_id AND b.rn = a.rn - a.off
    """,
)
def window_lag_row_offset(t):
    return ordered.shifted(
        t.events, ["user_id"], ["ts", "event_id"], "value", F.col("event_id") % 4, "earlier", F.lit(-1.0)
    ).select("event_id", "earlier")


@query(
    "window_first_last_nth", "2.5.9 2.5.10 2.5.11",
    """
    SELECT o_orderkey,
           first_value(o_orderkey) OVER w AS first_key,
           last_value(o_orderkey) OVER w AS last_key,
           nth_value(o_orderkey, 3) OVER w AS third_key,
           nth_value(o_orderkey, 1 + o_orderkey % 3) OVER w AS varying_key
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
    """,
)
def window_first_last_nth(t):
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    place = F.struct("o_orderdate", "o_orderkey")
    ends = o.groupBy("o_custkey").agg(
        F.min_by("o_orderkey", place).alias("first_key"), F.max_by("o_orderkey", place).alias("last_key")
    )
    heads = (
        ordered.first_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], 3)
        .groupBy("o_custkey").agg(F.sort_array(F.collect_list(place)).alias("heads"))
    )
    joined = o.join(ends, "o_custkey").join(heads, "o_custkey")
    pick = lambda i: F.get("heads", i)["o_orderkey"]
    return joined.select(
        "o_orderkey", "first_key", "last_key", pick(F.lit(2)).alias("third_key"),
        pick((F.col("o_orderkey") % 3).cast("int")).alias("varying_key"),
    )


@query(
    "window_nth_any", "2.5.11",
    """
    SELECT o_orderkey,
           nth_value(o_orderkey, 1 + o_orderkey % 5000) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS of_key,
           nth_value(o_orderkey, 12) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS twelfth,
           nth_value(o_orderkey, 1 + o_orderkey % 12) OVER (w ROWS BETWEEN 6 PRECEDING AND 4 FOLLOWING) AS of_frame,
           strftime(nth_value(o_orderdate, 1 + o_orderkey % 5000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate), '%Y-%m-%d') AS so_far
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)
    """,
)
def window_nth_any(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    date, number = ["o_orderdate", "o_orderkey"], F.col("o_orderkey")
    whole = ordered.nth_values(o, ["o_orderstatus"], date, "o_orderkey", {"of_key": 1 + number % 5000, "twelfth": 12})
    near = ordered.nth_values(o, ["o_orderstatus"], date, "o_orderkey", {"of_frame": 1 + number % 12}, frame=(6, 4))
    peers = ordered.nth_values(o, ["o_orderpriority"], ["o_orderdate"], "o_orderdate", {"so_far": 1 + number % 5000}, frame="range")
    out = whole.select("o_orderkey", "of_key", "twelfth").join(near.select("o_orderkey", "of_frame"), "o_orderkey")
    return out.join(peers.select("o_orderkey", F.date_format("so_far", "yyyy-MM-dd").alias("so_far")), "o_orderkey")


@query(
    "window_running_aggregates", "2.5.12",
    """
    SELECT event_id,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS run_cents,
           count(*) OVER w AS run_n,
           max(value) OVER w AS run_max, min(value) OVER w AS run_min,
           count(*) OVER (PARTITION BY event_type) AS all_n
    FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """,
)
def window_running_aggregates(t):
    e = t.events.select(
        "event_id", "event_type", "ts", "value", F.round(F.col("value") * 100).cast("long").alias("cents")
    )
    return ordered.running(
        e, ["event_type"], ["ts", "event_id"],
        {"run_cents": ("sum", "cents"), "run_n": ("count", "event_id"),
         "run_max": ("max", "value"), "run_min": ("min", "value")},
        totals={"all_n": ("count", "event_id")},
    ).select("event_id", "run_cents", "run_n", "run_max", "run_min", "all_n")


@query(
    "window_rows_frames", "2.5.13 2.5.15",
    """
    SELECT event_id,
           max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS back3,
           min(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around,
           count(value) OVER (w ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING) AS ahead,
           sum(event_id) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING)::BIGINT AS only_prev
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
    """,
)
def window_rows_frames(t):
    return ordered.sliding(
        t.events, ["event_type"], ["ts", "event_id"], 3, 4,
        {
            "back3": lambda w: F.max("value").over(w.rowsBetween(-3, 0)),
            "around": lambda w: F.min("value").over(w.rowsBetween(-2, 2)),
            "ahead": lambda w: F.count("value").over(w.rowsBetween(2, 4)),
            "only_prev": lambda w: F.sum("event_id").over(w.rowsBetween(-1, -1)),
        },
    ).select("event_id", "back3", "around", "ahead", "only_prev")


@query(
    "window_range_peers", "2.5.14",
    """
    SELECT event_id, day, CAST(sum(cents) OVER w AS BIGINT) AS upto_day, count(*) OVER w AS rows_upto
    FROM (SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day,
                 CAST(round(value * 100) AS BIGINT) AS cents FROM events)
    WINDOW w AS (PARTITION BY event_type ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def window_range_peers(t):
    # peers are summed first: the running step then sees one row per day and type
    e = t.events.select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    days = e.groupBy("event_type", "day").agg(F.sum("cents").alias("c"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event_type").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    upto = days.select("event_type", "day", F.sum("c").over(w).alias("upto_day"), F.sum("n").over(w).alias("rows_upto"))
    return e.join(upto, ["event_type", "day"]).select("event_id", "day", "upto_day", "rows_upto")


@query(
    "window_over_groups_named", "2.5.16 2.5.17 2.6.12",
    """
    SELECT o_orderpriority, y, n,
           CAST(sum(n) OVER p AS BIGINT) AS per_priority,
           CAST(sum(n) OVER (p ORDER BY y) AS BIGINT) AS to_date,
           CAST(sum(n) OVER () AS BIGINT) AS grand,
           rank() OVER (ORDER BY n DESC, o_orderpriority, y) AS place
    FROM (SELECT o_orderpriority, year(o_orderdate)::INTEGER AS y, count(*) AS n FROM orders GROUP BY ALL)
    WINDOW p AS (PARTITION BY o_orderpriority)
    """,
)
def window_over_groups_named(t):
    return t.sql(
        """
        SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n,
               sum(count(*)) OVER p AS per_priority,
               sum(count(*)) OVER to_date AS to_date,
               sum(count(*)) OVER () AS grand,
               rank() OVER (ORDER BY count(*) DESC, o_orderpriority, year(o_orderdate)) AS place
        FROM {orders} GROUP BY o_orderpriority, y
        WINDOW p AS (PARTITION BY o_orderpriority),
               to_date AS (PARTITION BY o_orderpriority ORDER BY year(o_orderdate))
        """
    )


@query(
    "window_with_filter", "2.5.18",
    """
    SELECT event_id,
           CAST(count(*) FILTER (WHERE event_type = 'error') OVER w AS BIGINT) AS errors_before,
           max(value) FILTER (WHERE value < 50) OVER w AS best_small
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
    """,
)
def window_with_filter(t):
    e = t.events.select(
        "event_id", "user_id", "ts", F.expr("if(event_type = 'error', 1, null)").alias("is_error"),
        F.when(F.col("value") < 50, F.col("value")).alias("small"),
    )
    return ordered.running(
        e, ["user_id"], ["ts", "event_id"],
        {"errors_before": ("count", "is_error"), "best_small": ("max", "small")},
    ).select("event_id", "errors_before", "best_small")
