"""Ordered operators against plain windows, with a hot key, NULL keys and no rows."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import intervals, joins, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, NULL keys, heavy ties, NULL values."""
    n = 6000
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.col("id") % 40).cast("int").alias("k"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).when(F.col("id") % 2 == 0, F.lit(5)).otherwise(F.pmod(F.xxhash64("id"), F.lit(500))).cast("long").alias("v"),
    ).cache()


def same(a, b):
    cols = sorted(a.columns)
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, a.select(*cols).collect()), key=str) == sorted(map(tuple, b.select(*cols).collect()), key=str)


@pytest.mark.parametrize("order", [["v", "id"], ["-v", "-id"], ["v", "-id"], ["-id"]])
def test_number_rows(skewed, order):
    w = Window.partitionBy("k").orderBy(*ordered.sort_columns(order))
    got = ordered.number_rows(skewed, ["k"], order, "rn", total="n", chunks=20)
    same(got, skewed.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))))


@pytest.mark.parametrize("order", [["v", "id"], ["id"], ["-id"]])
@pytest.mark.parametrize("chunks", [100, 3000])
def test_many_chunks_use_two_level_search(skewed, order, chunks):
    w = Window.orderBy(*ordered.sort_columns(order))
    got = ordered.number_rows(skewed, [], order, "rn", chunks=chunks)
    same(got, skewed.withColumn("rn", F.row_number().over(w)))


def test_a_made_key_is_made_once_a_row_not_once_a_bound(skewed):
    made = skewed.select("id", F.concat(F.lit("k"), F.col("v") % 3).alias("a"), F.col("v").alias("b"))
    got = ordered.number_rows(made, [], ["a", "b", "id"], "rn", chunks=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    compared = re.findall(r"lambdafunction\(\(lambda \S+ <= (.{7})", plan)
    assert compared and all(c.startswith("lambda ") for c in compared)
    w = Window.orderBy(*ordered.sort_columns(["a", "b", "id"]))
    same(got, made.withColumn("rn", F.row_number().over(w)))


def test_running(skewed):
    w = Window.partitionBy("k").orderBy(*ordered.sort_columns(["v", "id"])).rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running(
        skewed, ["k"], ["v", "id"],
        {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "id"), "hi": ("max", "id"), "l": ("last", "v")}, totals={"t": ("sum", "v")}, chunks=16,
    )
    want = skewed.select(
        "*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c"), F.min("id").over(w).alias("lo"), F.max("id").over(w).alias("hi"),
        F.last("v", ignorenulls=True).over(w).alias("l"), F.sum("v").over(Window.partitionBy("k")).alias("t"),
    )
    same(got, want)


def test_running_before(skewed):
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    got = ordered.running(skewed, ["k"], ["id"], {"hi": ("max", "v")}, inclusive=False)
    same(got, skewed.withColumn("hi", F.max("v").over(w)))


def test_sliding_over_block_edges(skewed):
    w = Window.partitionBy("k").orderBy("id")
    exprs = {
        "a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.lead("id", 2, -1).over(w), "c": lambda w: F.sum("id").over(w.rowsBetween(-3, 2)),
    }
    got = ordered.sliding(skewed, ["k"], ["id"], 3, 2, exprs, block_rows=7)
    same(got, skewed.select("*", *[f(w).alias(n) for n, f in exprs.items()]))


def test_ranks(skewed):
    w = Window.partitionBy("k").orderBy(F.col("v").desc_nulls_first())
    got = ordered.with_ranks(skewed, ["k"], ["-v"])
    want = skewed.select("*", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"))
    same(got.select(want.columns), want)


def test_ntile_and_null_count(spark, skewed):
    w = Window.partitionBy("k").orderBy("id")
    for n in (1, 4, 1000):
        got = ordered.number_rows(skewed, ["k"], ["id"], "rn", total="t").select("id", ordered.ntile(F.col("rn"), F.col("t"), n).cast("int").alias("x"))
        same(got, skewed.select("id", F.ntile(n).over(w).alias("x")))
    assert ordered.number_rows(skewed, ["k"], ["id"], "rn").select(ordered.ntile(F.col("rn"), F.lit(None).cast("int"), 4).alias("x")).filter("x is not null").isEmpty()


def test_percentiles(spark, skewed):
    got = ordered.exact_percentiles(skewed, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.37, "d": 1.0})
    want = skewed.filter("v is not null").groupBy("k").agg(*[F.expr(f"percentile(v, {p})").alias(n) for n, p in (("a", 0.0), ("b", 0.5), ("c", 0.37), ("d", 1.0))])
    rounded = lambda df: df.select("k", *[F.round(c, 6).alias(c) for c in "abcd"])
    same(rounded(got), rounded(want))


def test_empty_input(skewed):
    none = skewed.filter("id < 0")
    assert ordered.number_rows(none, ["k"], ["id"]).isEmpty()
    assert ordered.running(none, ["k"], ["id"], {"s": ("sum", "v")}).isEmpty()
    assert ordered.exact_percentiles(none, ["k"], "v", {"m": 0.5}).isEmpty()


def test_salted_join_equals_plain_join(spark, skewed):
    right = spark.range(40).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        same(joins.salted_join(skewed, right, ["k"], how, hot_rows=500, salts=6), skewed.join(right, ["k"], how))


def test_overlap_join_brute_force(spark):
    a = spark.range(300).select(F.col("id").alias("a"), (F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000))).alias("lo")).withColumn("hi", F.col("lo") + F.col("a") % 90)
    b = spark.range(300).select(F.col("id").alias("b"), (F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000))).alias("l2")).withColumn("h2", F.col("l2") + F.pow(F.lit(2), F.col("b") % 9).cast("long"))
    got = joins.overlap_join(a, b, ("lo", "l2"), ("hi", "h2"), ["k"]).select("a", "b")
    want = a.join(b, "k").filter("lo < h2 AND l2 < hi AND lo < hi AND l2 < h2").select("a", "b")
    same(got, want)


def test_overlap_join_of_copies(spark):
    a = spark.range(50).select(F.col("id").alias("a"), F.lit(10).alias("lo"), F.lit(20).alias("hi"))
    b = spark.range(40).select(F.col("id").alias("b"), F.lit(10).alias("l2"), F.lit(12).alias("h2"))
    assert joins.overlap_join(a, b, ("lo", "l2"), ("hi", "h2")).count() == 2000


def test_nearest_join(spark):
    a = spark.range(200).select(F.col("id").alias("a"), F.lit(1).alias("k"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("t"))
    b = spark.range(60).select(F.col("id").alias("b"), F.lit(1).alias("k"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)).alias("u"))
    got = joins.nearest_join(a, b, ["k"], ("t", "u"), ("a", "b"), ["b", "u"]).select("a", F.abs(F.col("t") - F.col("match.u")).alias("d"))
    want = a.join(b, "k").groupBy("a").agg(F.min(F.abs(F.col("t") - F.col("u"))).alias("d"))
    same(got, want)


def test_neighbours_join_ties_nulls_and_hot_key(spark):
    times = lambda salt, n: F.when(F.col("id") % 29 == 0, F.lit(None)).when(F.col("id") % 3 == 0, F.lit(n // 2)).otherwise(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)))
    keys = F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.col("id") % 5)
    a = spark.range(900).select(F.col("id").alias("a"), keys.alias("k"), times(1, 200).alias("t"))
    b = spark.range(300).select(F.col("id").alias("b"), keys.alias("k"), times(2, 200).alias("u"))
    got = joins.neighbours_join(a, b, ["k"], ("t", "u"), ("a", "b"), ["b", "u"])
    pairs = a.alias("x").join(b.alias("y"), F.col("x.k").eqNullSafe(F.col("y.k")), "left")
    place = F.struct("u", "b")
    want = pairs.groupBy("x.a").agg(
        F.max_by("b", F.when(F.col("u") <= F.col("t"), place)).alias("before"), F.min_by("b", F.when(F.col("u") >= F.col("t"), place)).alias("after")
    )
    same(got.select("a", F.col("before.b").alias("before"), F.col("after.b").alias("after")), want)
    assert joins.neighbours_join(a, b.limit(0), ["k"], ("t", "u"), ("a", "b"), ["b"]).filter("before is null and after is null").count() == 900
    assert joins.neighbours_join(a.limit(0), b, ["k"], ("t", "u"), ("a", "b"), ["b"]).count() == 0


def test_neighbours_join_orders_once(spark):
    a = spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("t"))
    plan = joins.neighbours_join(a, a.toDF("b", "u"), [], ("t", "u"), ("a", "b"), ["b"])._jdf.queryExecution().optimizedPlan().toString()
    # the rows and the totals of their chunks, each a scan of both sides
    assert plan.count("Range (") == 4


def test_running_next_over_chunks(skewed):
    w = Window.partitionBy("k").orderBy(*ordered.sort_columns(["v", "id"])).rowsBetween(0, Window.unboundedFollowing)
    rows = skewed.withColumn("x", F.when(F.col("id") % 50 == 0, F.col("id")))
    got = ordered.running(rows, ["k"], ["v", "id"], {"n": ("next", "x"), "c": ("count", "id")}, chunks=30).drop("c")
    same(got, rows.withColumn("n", F.first("x", ignorenulls=True).over(w)))
    with pytest.raises(ValueError, match="direction"):
        ordered.running(rows, ["k"], ["v", "-id"], {"n": ("next", "x")})


@pytest.mark.parametrize("frame", [(None, None), (None, 0), (0, None), (5, 3), (-2, 4), (7, -1), "range"])
def test_nth_values(skewed, frame):
    order = ["v"] if frame == "range" else ["v", "-id"]
    value = "v" if frame == "range" else "id"
    w = Window.partitionBy("k").orderBy(*ordered.sort_columns(order))
    if frame != "range":
        w = w.rowsBetween(Window.unboundedPreceding if frame[0] is None else -frame[0], Window.unboundedFollowing if frame[1] is None else frame[1])
    place = F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(1 + F.pmod(F.col("id"), F.lit(9 if frame == (5, 3) else 2500)))
    got = ordered.nth_values(skewed, ["k"], order, value, {"own": place, "third": 3, "far": 1000000}, frame=frame, chunks=20)
    listed = skewed.withColumn("l", F.collect_list(F.struct(F.col(value).alias("x"))).over(w)).withColumn("p", place)
    want = listed.select(
        "id", "k", "v", F.get("l", (F.col("p") - 1).cast("int"))["x"].alias("own"), F.get("l", F.lit(2))["x"].alias("third"), F.lit(None).cast("long").alias("far")
    )
    same(got, want)


def test_nth_values_inputs(skewed):
    with pytest.raises(Exception, match="greater than zero"):
        ordered.nth_values(skewed, ["k"], ["v", "id"], "id", {"x": F.col("id") % 2}).collect()
    assert ordered.nth_values(skewed.limit(0), ["k"], ["v", "id"], "id", {"x": 1}).count() == 0


def test_trigram_and_edit_joins_brute_force(spark):
    from tablewright.functions import strings

    rows = [(w,) for w in "blue bolt|blue bolts|blu bolt|red gear|red gears|gear red|old ring|new ring|ringing|bolt|bolts|volt".split("|")]
    a, b = spark.createDataFrame(rows, "a string"), spark.createDataFrame(rows, "b string")
    sim = strings.similarity(F.col("a"), F.col("b"))
    for limit in (0.3, 0.5, 0.8):
        same(joins.trigram_join(a, b, "a", "b", limit).select("a", "b"), a.crossJoin(b).filter(sim >= limit))
    same(joins.edit_one_join(a, b, "a", "b").select("a", "b"), a.crossJoin(b).filter(F.levenshtein("a", "b") <= 1))


def test_packing_keeps_touching_and_drops_empty(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11), (1, 20, 20), (None, 1, 2)], "k int, lo int, hi int")
    assert sorted(map(tuple, intervals.pack(df, ["k"], "lo", "hi").collect()), key=str) == sorted([(1, 0, 7, 2), (1, 9, 12, 2), (None, 1, 2, 1)], key=str)
    assert [tuple(r) for r in intervals.gaps(df, ["k"], "lo", "hi").collect()] == [(1, 7, 9)]


def test_percentiles_make_their_values_once(spark):
    df = spark.range(100).select(F.length(F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("n"))
    got = ordered.exact_percentiles(df, [], "n", {"p": 0.5}, "disc")
    assert "repeat(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().p == 49
