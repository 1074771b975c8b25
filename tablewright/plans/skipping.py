"""Data skipping over tables laid out in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import textsearch as ts
from tablewright.operators import search, skipping
from tablewright.plans.joins import SPANS_SQL, busy_spans
from tablewright.plans.registry import query
from tablewright.session import scratch_path

_layouts: dict[tuple[str, str, str], str] = {}


def layout(t, name: str, frame, column: str, stray, spread):
    """Table laid out in blocks by a column, loosely: rows that are ``stray`` are spread by ``spread``, a number.

    Written once per session and source folder.
    """
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _layouts:
        path = scratch_path(t.spark, f"layout-{name}")
        lo, hi, n = frame.agg(F.min(column), F.max(column), F.count(F.lit(1))).first()
        blocks = skipping.block_count(n)
        spot = (F.col(column) - F.lit(lo)) / F.lit(max(hi - lo, 1))
        skipping.write_blocks(frame, path, F.when(stray, F.pmod(spread, F.lit(blocks))).otherwise(F.floor(spot * (blocks - 1))))
        _layouts[key] = path
    return skipping.read_blocks(t.spark, _layouts[key])


def lines(t):
    src = t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).alias("ship_day")
    )
    return layout(t, "lineitem", src, "ship_day", (F.col("l_orderkey") + F.col("l_partkey")) % 10 == 0, F.col("l_orderkey") + 7 * F.col("l_partkey"))


LINES = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_returnflag, date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS ship_day FROM lineitem)"


@query(
    "hist_skip_range", "2.21.1 2.21.2 2.21.3 2.21.4 2.21.5 2.21.6",
    f"SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM {LINES} WHERE ship_day BETWEEN 700 AND 730 GROUP BY 1",
)
def hist_skip_range(t):
    table = lines(t)
    index = skipping.Index.build(table, "ship_day", buckets=400, density=20)
    rows = skipping.pruned(table, index.candidates("between", 700, 730)).filter("ship_day BETWEEN 700 AND 730")
    return rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


OPS = [("<", 40), ("<=", 40), ("=", 900), (">=", 2380), (">", 2380), ("=", -5)]


@query(
    "hist_skip_operators", "2.21.6 2.21.9",
    " UNION ALL ".join(f"SELECT '{op} {v}' AS predicate, count(*) AS n FROM {LINES} WHERE ship_day {op} {v}" for op, v in OPS),
)
def hist_skip_operators(t):
    table = lines(t)
    index = skipping.Index.build(table, "ship_day", buckets=100)
    out = None
    for op, v in OPS:
        rows = skipping.pruned(table, index.candidates(op, v)).filter(f"ship_day {op} {v}")
        part = rows.agg(F.lit(f"{op} {v}").alias("predicate"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("hist_skip_types", "2.21.9", "SELECT 'timestamp' AS kind, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-03' UNION ALL SELECT 'double', count(*) FROM events WHERE value > 150")
def hist_skip_types(t):
    table = layout(t, "events", t.events, "event_id", F.col("event_id") % 10 == 0, F.col("event_id") * 7)
    day3 = 1704240000 * 1_000_000
    by_time = skipping.Index.build(table, "ts", buckets=50).candidates("<", day3)
    by_value = skipping.Index.build(table, "value", buckets=50).candidates(">", 150.0)
    a = skipping.pruned(table, by_time).filter("ts < timestamp_ntz'2024-01-03'")
    b = skipping.pruned(table, by_value).filter("value > 150")
    tally = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return tally("timestamp", a).unionByName(tally("double", b))


#: Buckets of ten days; the stretch of days beyond 2,000 lies outside.
DAY_EDGES = [float(d) for d in range(0, 2001, 10)]


@query(
    "hist_summary_entries", "2.21.3 2.21.4 2.21.5",
    f"""
    WITH RECURSIVE ranged AS (
      SELECT *, min(ship_day) OVER () AS lo, max(ship_day) OVER () AS hi, floor(sqrt(count(*) OVER () // 25))::INTEGER AS k FROM {LINES}
    ), placed AS (
      SELECT CASE WHEN (l_orderkey + l_partkey) % 10 = 0 THEN (l_orderkey + 7 * l_partkey) % k ELSE floor((ship_day - lo) / greatest(hi - lo, 1) * (k - 1)) END::INTEGER AS block,
             CASE WHEN ship_day BETWEEN 0 AND 2000 THEN least(ship_day // 10, 199) ELSE -9999 END AS b FROM ranged
    ), blocks AS (
      SELECT row_number() OVER (ORDER BY block) AS i, block, s, n FROM (SELECT block, list(DISTINCT b) AS s, count(*) AS n FROM placed GROUP BY block)
    ), fold AS (
      SELECT i, block, n, 0::BIGINT AS entry, s AS held FROM blocks WHERE i = 1
      UNION ALL
      SELECT c.i, c.block, c.n, CASE WHEN len(f.held) > 40 THEN f.entry + 1 ELSE f.entry END, CASE WHEN len(f.held) > 40 THEN c.s ELSE list_distinct(list_concat(f.held, c.s)) END
      FROM fold f JOIN blocks c ON c.i = f.i + 1
    )
    SELECT entry, min(block) AS first_block, max(block) AS last_block, count(*) AS blocks, sum(n)::BIGINT AS rows, max(len(held))::INTEGER AS n_buckets FROM fold GROUP BY entry
    """,
)
def hist_summary_entries(t):
    index = skipping.Index.build(lines(t), "ship_day", density=20, edges=DAY_EDGES)
    return index.entries.select("entry", "first_block", "last_block", "blocks", "rows", F.size("buckets").alias("n_buckets"))


@query(
    "hist_skip_after_insert", "2.21.7",
    f"SELECT count(*) AS n FROM {LINES} WHERE ship_day > 2400 OR l_linenumber = 7",
)
def hist_skip_after_insert(t):
    # every seventh line also arrives late, dated beyond the histogram, in blocks of its own
    table = lines(t)
    index = skipping.Index.build(table, "ship_day", buckets=400)
    late, first = scratch_path(t.spark, "late"), index.next_block()
    rows = table.filter("l_linenumber = 7 AND ship_day <= 2400").withColumn("ship_day", F.lit(100009)).drop("block")
    skipping.write_blocks(rows, late, F.pmod("l_orderkey", F.lit(skipping.block_count(rows.count()))) + first)
    more = skipping.read_blocks(t.spark, late)
    index = index.add_blocks(more)
    rows = skipping.pruned(table.unionByName(more), index.candidates(">", 2400)).filter("ship_day > 2400")
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(
    "hist_skip_after_delete", "2.21.8",
    f"SELECT count(*) AS n FROM {LINES} WHERE ship_day BETWEEN 690 AND 760 AND NOT (ship_day > 700 AND ship_day < 720)",
)
def hist_skip_after_delete(t):
    # the blocks touched are written again under new numbers; the summary drops the old ones
    table = lines(t)
    index = skipping.Index.build(table, "ship_day", buckets=400)
    touched, first = index.candidates("between", 700, 720), index.next_block()
    rewritten = scratch_path(t.spark, "rewritten")
    skipping.write_blocks(skipping.pruned(table, touched).filter("NOT (ship_day > 700 AND ship_day < 720)"), rewritten, F.col("block") + first)
    fresh = skipping.read_blocks(t.spark, rewritten)
    index = index.replace_blocks(touched, fresh)
    rows = skipping.pruned(table.unionByName(fresh), index.candidates("between", 690, 760)).filter("ship_day BETWEEN 690 AND 760")
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query(
    "minmax_skip", "2.21.10",
    f"SELECT l_orderkey, l_linenumber, l_partkey, ship_day FROM {LINES} WHERE ship_day < 15",
)
def minmax_skip(t):
    table = lines(t)
    summary = skipping.minmax_summary(table, ["ship_day", "l_partkey"])
    blocks = skipping.minmax_candidates(summary, "ship_day", "<", 15)
    return skipping.pruned(table, blocks).filter("ship_day < 15").select("l_orderkey", "l_linenumber", "l_partkey", "ship_day")


@query(
    "inclusion_skip", "2.21.11",
    f"SELECT span_id FROM ({SPANS_SQL}) WHERE lo <= 1704300000000000 AND hi >= 1704250000000000",
)
def inclusion_skip(t):
    table = layout(t, "spans", busy_spans(t), "lo", F.col("span_id") % 10 == 0, F.col("span_id") * 7)
    blocks = skipping.inclusion_candidates(skipping.inclusion_summary(table, F.col("lo"), F.col("hi")), 1704250000000000, 1704300000000000)
    return skipping.pruned(table, blocks).filter("lo <= 1704300000000000 AND hi >= 1704250000000000").select("span_id")


@query("bloom_skip", "2.21.12", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey = 77 AND l_linenumber = 3")
def bloom_skip(t):
    table = lines(t)
    signatures = skipping.Signatures.build(table, ["l_partkey", "l_linenumber"], error=0.01)
    blocks = signatures.candidates(l_partkey=F.lit(77).cast("long"), l_linenumber=F.lit(3))
    return skipping.pruned(table, blocks).filter("l_partkey = 77 AND l_linenumber = 3").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "postings_lookup", "2.21.13 2.18.3",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'with') AND NOT list_contains(w, 'was')
    """,
)
def postings_lookup(t):
    path = scratch_path(t.spark, "postings")
    parts = skipping.write_postings(search.postings(t.spread("documents", "doc_id"), "doc_id", ts.to_vector(F.col("text"))), "term", path)
    index = skipping.read_postings(t.spark, path, "term", ["the", "with", "was"], parts)
    return search.match_postings(index, "doc_id", ["the", "with"], ["was"])


@query(
    "skip_and_or", "2.21.14",
    f"SELECT 'and' AS kind, count(*) AS n FROM {LINES} WHERE ship_day BETWEEN 100 AND 140 AND l_partkey = 77 UNION ALL SELECT 'or', count(*) FROM {LINES} WHERE ship_day < 20 OR ship_day > 2400",
)
def skip_and_or(t):
    table = lines(t)
    index = skipping.Index.build(table, "ship_day", buckets=200)
    signatures = skipping.Signatures.build(table, ["l_partkey"], error=0.01)
    blocks = skipping.both(index.candidates("between", 100, 140), signatures.candidates(l_partkey=F.lit(77).cast("long")))
    a = skipping.pruned(table, blocks).filter("ship_day BETWEEN 100 AND 140 AND l_partkey = 77")
    blocks = skipping.either(index.candidates("<", 20), index.candidates(">", 2400))
    b = skipping.pruned(table, blocks).filter("ship_day < 20 OR ship_day > 2400")
    tally = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return tally("and", a).unionByName(tally("or", b))
