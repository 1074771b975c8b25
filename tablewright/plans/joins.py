"""Joins of every form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import strings
from tablewright.operators import joins, ordered
from tablewright.plans.registry import query


@query(
    "join_inner_hash", "2.3.1",
    """
    SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY ALL
    """,
)
def join_inner_hash(t):
    o = t.orders.filter("o_orderdate >= timestamp_ntz'1998-01-01'")
    return (
        t.lineitem.join(o.hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority", "l_returnflag")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    )


@query(
    "join_inner_merge", "2.3.2",
    """
    SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE c_acctbal < 0 OR o_totalprice > 400000
    """,
)
def join_inner_merge(t):
    return (
        t.orders.join(t.customer.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
        .filter((F.col("c_acctbal") < 0) | (F.col("o_totalprice") > 400000))
        .select("o_orderkey", "o_custkey", "c_name")
    )


BANDS = "(VALUES (0, 0.0, 50000.0), (1, 50000.0, 150000.0), (2, 120000.0, 300000.0), (3, 300000.0, 1e12)) AS b(band, lo, hi)"


@query(
    "join_theta", "2.3.3 2.1.3",
    f"""
    SELECT o_orderpriority, band, count(*) AS n
    FROM orders JOIN {BANDS} ON o_totalprice > lo AND o_totalprice <= hi GROUP BY ALL
    """,
)
def join_theta(t):
    # four literal bands: the broadcast side has a fixed size
    return t.sql(
        f"""
        SELECT /*+ BROADCAST(b) */ o_orderpriority, band, count(*) AS n
        FROM {{orders}} JOIN {BANDS} ON o_totalprice > lo AND o_totalprice <= hi GROUP BY ALL
        """
    )


@query(
    "join_left_right", "2.3.4",
    """
    SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top FROM customer
    LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey
    """,
)
def join_left_right(t):
    o = t.orders.filter("o_orderstatus = 'F'")
    return (
        o.join(t.customer, F.col("c_custkey") == F.col("o_custkey"), "right")
        .groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top"))
    )


@query(
    "join_full", "2.3.5",
    """
    SELECT coalesce(a.k, b.k) AS k, a.n AS n_high, b.n AS n_low
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) a
    FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice < 20000 GROUP BY 1) b ON a.k = b.k
    """,
)
def join_full(t):
    side = lambda cond, name: t.orders.filter(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(name))
    return side("o_totalprice > 400000", "n_high").join(side("o_totalprice < 20000", "n_low"), "k", "full")


@query(
    "join_cross", "2.3.6",
    """
    SELECT r_name, o_orderpriority, count(n_nationkey) AS nations
    FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)
    LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL
    """,
)
def join_cross(t):
    # product of two closed domains, each checked before it is broadcast
    priorities = joins.broadcast_if_small(t.orders.select("o_orderpriority").distinct(), 1000)
    grid = t.region.crossJoin(priorities)
    return (
        grid.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy("r_name", "o_orderpriority").agg(F.count("n_nationkey").alias("nations"))
    )


@query(
    "join_natural_using", "2.3.7",
    """
    SELECT n_nationkey, n_name, r_name, customers
    FROM (SELECT n_nationkey, n_name, n_regionkey AS r_regionkey FROM nation) NATURAL JOIN region
    JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS customers FROM customer GROUP BY 1) USING (n_nationkey)
    """,
)
def join_natural_using(t):
    per = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    nat = t.sql(
        "SELECT n_nationkey, n_name, r_name FROM (SELECT n_nationkey, n_name, n_regionkey AS r_regionkey FROM {nation}) NATURAL JOIN {region}"
    )
    return nat.join(per, "n_nationkey")


@query(
    "join_semi", "2.3.8",
    """
    SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS
      (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
    """,
)
def join_semi(t):
    big = t.orders.filter("o_totalprice > 450000")
    return t.customer.join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query(
    "join_anti", "2.3.9",
    "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def join_anti(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query(
    "join_not_in_nulls", "2.3.10",
    """
    WITH small AS (SELECT CASE WHEN o_totalprice < 60000 THEN o_custkey END AS k FROM orders WHERE o_totalprice < 80000),
         clean AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice < 80000)
    SELECT 'with null' AS kind, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT k FROM small)
    UNION ALL SELECT 'no null', count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM clean)
    """,
)
def join_not_in_nulls(t):
    low = t.orders.filter("o_totalprice < 80000")
    keys = {
        "with null": low.select(F.when(F.col("o_totalprice") < 60000, F.col("o_custkey")).alias("k")),
        "no null": low.select(F.col("o_custkey").alias("k")),
    }
    out = None
    for kind, k in keys.items():
        # NOT IN over any NULL keeps nothing: one flag decides, the rest is an anti join that can shuffle
        has_null = k.agg(F.coalesce(F.bool_or(F.col("k").isNull()), F.lit(False)).alias("has_null"))
        kept = t.customer.join(k, F.col("c_custkey") == F.col("k"), "left_anti").crossJoin(has_null)
        part = kept.filter("not has_null").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "join_lateral_top", "2.3.11",
    """
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer,
    LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
             ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)
    WHERE c_acctbal > 0
    """,
)
def join_lateral_top(t):
    top = ordered.first_per_key(t.orders, ["o_custkey"], ["-o_totalprice", "o_orderkey"], 2)
    return t.customer.filter("c_acctbal > 0").join(top, F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", "o_orderkey", "o_totalprice"
    )


def busy_spans(t):
    """Per user: a span from each purchase to ten minutes per unit of value later."""
    return t.events.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("span_id"), F.col("user_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("lo"),
        (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 100).cast("long") * 6000000).alias("hi"),
    )


SPANS_SQL = """
  SELECT event_id AS span_id, user_id, epoch_us(ts) AS lo,
         epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 6000000 AS hi
  FROM events WHERE event_type = 'purchase'
"""


@query(
    "join_overlap", "2.3.12",
    f"""
    WITH s AS ({SPANS_SQL}),
    e AS (SELECT event_id AS span_id, user_id, epoch_us(ts) AS lo,
                 epoch_us(ts) + CAST(round(value * 10) AS BIGINT) * 60000000 AS hi FROM events WHERE event_type = 'error')
    SELECT s.span_id, e.span_id AS error_id FROM s JOIN e ON s.user_id = e.user_id AND s.lo < e.hi AND e.lo < s.hi
    WHERE s.lo < s.hi AND e.lo < e.hi
    """,
)
def join_overlap(t):
    errors = t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), "user_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("elo"),
        (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 10).cast("long") * 60000000).alias("ehi"),
    )
    return joins.overlap_join(busy_spans(t), errors, ("lo", "elo"), ("hi", "ehi"), ["user_id"]).select("span_id", "error_id")


@query(
    "join_point_in_interval", "2.3.13",
    f"""
    WITH s AS ({SPANS_SQL})
    SELECT s.span_id, event_id FROM s JOIN events e
    ON s.user_id = e.user_id AND epoch_us(e.ts) >= s.lo AND epoch_us(e.ts) < s.hi WHERE event_type <> 'purchase'
    """,
)
def join_point_in_interval(t):
    points = t.events.filter("event_type <> 'purchase'").select(
        "event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )
    return joins.point_in_interval_join(points, busy_spans(t), "at", "lo", "hi", ["user_id"]).select("span_id", "event_id")


@query(
    "join_within_distance", "2.3.14",
    """
    WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label FROM embeddings)
    SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 9) AS distance
    FROM p a JOIN p b ON a.vec_id < b.vec_id
    WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 0.01
    """,
)
def join_within_distance(t):
    p = lambda side: t.embeddings.select(
        F.col("vec_id").alias(side), F.col("embedding")[0].cast("double").alias(f"x{side}"),
        F.col("embedding")[1].cast("double").alias(f"y{side}"), 
    )
    out = joins.within_distance_join(
        p("a"), p("b"), ["xa", "ya"], ["xb", "yb"], 0.01
    ).filter("a < b")
    return out.select("a", "b", F.round("distance", 9).alias("distance"))


@query(
    "nearest_k_points", "2.3.14",
    """
    SELECT vec_id, round(sqrt((embedding[1]-0.01)*(embedding[1]-0.01) + (embedding[2]+0.02)*(embedding[2]+0.02)), 6) AS d
    FROM (SELECT vec_id, embedding[1:2]::DOUBLE[] AS embedding FROM embeddings)
    ORDER BY sqrt((embedding[1]-0.01)*(embedding[1]-0.01) + (embedding[2]+0.02)*(embedding[2]+0.02)), vec_id LIMIT 10
    """,
)
def nearest_k_points(t):
    x, y = (F.col("embedding")[i].cast("double") for i in (0, 1))
    d = F.sqrt((x - 0.01) * (x - 0.01) + (y + 0.02) * (y + 0.02))
    return t.embeddings.select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", F.round("d", 6).alias("d"))


@query(
    "join_asof_nearest", "2.3.15",
    """
    WITH c AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click'),
    p AS (SELECT event_id AS pid, user_id, epoch_us(ts) AS pat FROM events WHERE event_type = 'purchase'),
    b AS (SELECT c.event_id, p.pid, p.pat, c.at FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.at >= p.pat),
    f AS (SELECT c.event_id, p.pid, p.pat FROM c ASOF LEFT JOIN p ON c.user_id = p.user_id AND c.at <= p.pat)
    SELECT b.event_id, b.pid AS before_id, f.pid AS after_id,
           CASE WHEN b.pid IS NULL OR f.pat - b.at < b.at - b.pat THEN f.pid ELSE b.pid END AS nearest_id
    FROM b JOIN f USING (event_id)
    """,
)
def join_asof_nearest(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    clicks = t.events.filter("event_type = 'click'").select("event_id", "user_id", at.alias("at"))
    buys = t.events.filter("event_type = 'purchase'").select(F.col("event_id").alias("pid"), "user_id", at.alias("pat"))
    both = joins.neighbours_join(
        clicks, buys, ["user_id"], ("at", "pat"), ("event_id", "pid"), ["pid", "pat"], ("back", "fore")
    )
    near = F.when(
        F.col("back").isNull() | (F.col("fore.pat") - F.col("at") < F.col("at") - F.col("back.pat")), F.col("fore.pid")
    ).otherwise(F.col("back.pid"))
    return both.select("event_id", F.col("back.pid").alias("before_id"), F.col("fore.pid").alias("after_id"), near.alias("nearest_id"))


def titles(t):
    return t.spread("pages", "page_id").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


TRGM_MACRO = """
  toks AS (SELECT DISTINCT txt, w FROM (SELECT txt, unnest(regexp_split_to_array(lower(txt), '[^\\p{L}\\p{N}]+')) AS w FROM txts) WHERE w <> ''),
  g AS (SELECT DISTINCT txt, substr('  ' || w || ' ', CAST(i AS BIGINT), 3) AS g FROM toks, LATERAL (SELECT unnest(range(1, length(w) + 2)) AS i)),
  sz AS (SELECT txt, count(*) AS n FROM g GROUP BY 1)
"""


@query(
    "join_trigram", "2.3.16 2.9.36",
    f"""
    WITH txts AS (SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS txt FROM pages), {TRGM_MACRO},
    p AS (SELECT x.txt AS a, y.txt AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.txt < y.txt GROUP BY ALL)
    SELECT a, b, round(shared / (sa.n + sb.n - shared), 6) AS similarity
    FROM p JOIN sz sa ON a = sa.txt JOIN sz sb ON b = sb.txt WHERE shared / (sa.n + sb.n - shared) >= 0.3
    """,
)
def join_trigram(t):
    left = titles(t).select(F.col("title").alias("a"))
    right = titles(t).select(F.col("title").alias("b"))
    return joins.trigram_join(left, right, "a", "b", 0.3, ascending=True).filter("a < b").select("a", "b", F.round("similarity", 6).alias("similarity"))


SOUND_SQL = """rpad(upper(w[1]) || regexp_replace(substr(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  translate(upper(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202'),
  '1+','1','g'),'2+','2','g'),'3+','3','g'),'4+','4','g'),'5+','5','g'),'6+','6','g'), 2), '[^1-6]', '', 'g'), 4, '0')"""


@query(
    "fuzzy_record_link", "2.9.33 2.9.34 2.9.35",
    f"""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+')) AS w FROM pages),
    q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark),
    a AS (SELECT w, substr({SOUND_SQL}, 1, 4) AS code FROM w), b AS (SELECT w, substr({SOUND_SQL}, 1, 4) AS code FROM q)
    SELECT a.code, a.w AS left_word, b.w AS right_word, levenshtein(a.w, b.w)::INTEGER AS distance
    FROM a JOIN b ON a.code = b.code WHERE levenshtein(a.w, b.w) <= 1
    """,
)
def fuzzy_record_link(t):
    def vocabulary(text, name):
        w = F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias(name)
        return lambda df: df.select(w).distinct().withColumn("code", F.substring(strings.sound_code(F.col(name)), 1, 4))

    a = vocabulary(F.col("title"), "left_word")(titles(t))
    b = vocabulary(F.col("text"), "right_word")(t.benchmark)
    return joins.edit_one_join(a, b, "left_word", "right_word", ["code"]).select("code", "left_word", "right_word", "distance")


@query(
    "join_edit_distance", "2.9.33",
    """
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]+')) AS w FROM pages),
    q AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)
    SELECT a.w AS left_word, b.w AS right_word, levenshtein(a.w, b.w)::INTEGER AS distance FROM w a, q b WHERE abs(length(a.w) - length(b.w)) <= 2 AND levenshtein(a.w, b.w) <= 2
    """,
)
def join_edit_distance(t):
    vocabulary = lambda df, text, name: df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)).alias(name))
    return joins.edit_join(vocabulary(titles(t), "title", "left_word"), vocabulary(t.benchmark, "text", "right_word"), "left_word", "right_word", 2)


@query(
    "join_salted_hot_key", "2.3.1 2.3.4",
    """
    SELECT e.event_type, s.weight, count(*) AS n, round(sum(value * s.weight), 2) AS weighted
    FROM events e LEFT JOIN (SELECT event_type, count(*) AS weight FROM events WHERE value > 100 GROUP BY 1) s
    ON e.event_type = s.event_type GROUP BY ALL
    """,
)
def join_salted_hot_key(t):
    weights = t.events.filter("value > 100").groupBy("event_type").agg(F.count(F.lit(1)).alias("weight"))
    out = joins.salted_join(t.events, weights, ["event_type"], "left", hot_rows=1000, salts=8)
    return out.groupBy("event_type", "weight").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value") * F.col("weight")), 2).alias("weighted")
    )
