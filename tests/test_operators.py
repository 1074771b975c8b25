"""Operators on small fixtures: changes, recursion, samples, feeds."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import dml, networks, recursion, relational
from tablewright.functions import net
from tablewright.session import scratch_path
from tablewright.sources import versions
from tablewright.streaming import changes


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_rules(spark):
    t = spark.createDataFrame([(1, "apple"), (2, "pear")], "key int, fruit string")
    p = spark.createDataFrame([(2, "fig"), (3, "kiwi")], "key int, fruit string")
    out = dml.upsert(t, p, ["key"], {"fruit": F.concat("fruit", F.lit("+"), F.col("excluded.fruit"))})
    assert rows(out.table) == [(1, "apple"), (2, "pear+fig"), (3, "kiwi")]
    assert rows(out.returning) == [(2, "pear+fig"), (3, "kiwi")]
    assert rows(dml.upsert(t, p, ["key"], {"fruit": F.lit("x")}, where=F.col("key") > 5).returning) == [(3, "kiwi")]
    twice = p.unionByName(p)
    with pytest.raises(dml.DuplicateProposal):
        dml.upsert(t, twice, ["key"], {"fruit": F.lit("x")})
    assert dml.upsert(t, twice, ["key"]).table.count() == 3


def test_restrict_and_set_null(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, ref int")
    gone = spark.createDataFrame([(10,)], "id int")
    with pytest.raises(ValueError):
        dml.on_parent_delete(child, gone, ["ref"], ["id"], "restrict")
    assert rows(dml.on_parent_delete(child, gone, ["ref"], ["id"], "set null")) == [(1, None), (2, None), (3, 30)]
    assert rows(dml.on_parent_delete(child, gone, ["ref"], ["id"], "cascade")) == [(2, None), (3, 30)]
    assert rows(dml.orphans(child, gone, ["ref"], ["id"])) == [(3, 30)]


def test_diff_and_versions(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d")], "k int, v string")
    d = dml.diff(old, new, ["k"])
    assert rows(d.select("k", "op")) == [(2, "U"), (3, "D"), (4, "I")]
    assert rows(dml.apply_diff(old, d, ["k"])) == rows(new)
    base = scratch_path(spark, "versions")
    versions.publish(old, base)
    versions.publish(new, base)
    assert rows(versions.current(spark, base)) == rows(new)
    assert rows(versions.current(spark, base, 1)) == rows(old)


def test_recursion_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "f int, t int")
    seed = spark.createDataFrame([(1,)], "n int")
    step = lambda r: r.join(edges, F.col("n") == F.col("f")).select(F.col("t").alias("n"))
    assert rows(recursion.fixpoint(seed, step)) == [(1,), (2,), (3,), (4,)]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (1, 5)], "k int, p int")
    walk = recursion.connect_by(tree, "k", "p", F.col("p").isNull())
    assert rows(walk.select("k", "level", "branch")) == [(1, 0, "1"), (2, 1, "1~2"), (3, 1, "1~3"), (4, 2, "1~2~4"), (5, 3, "1~2~4~5")]
    assert recursion.connect_by(tree, "k", "p", F.col("p").isNull(), max_depth=1).count() == 3


def test_bags(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert rows(relational.intersect_all(a, b)) == rows(a.intersectAll(b))
    assert rows(relational.except_all(a, b)) == rows(a.exceptAll(b))


def test_address_join(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("192.168.0.1",), ("fd00::5",)], "t string").select("t", net.parse(F.col("t")).alias("ip"))
    nets = spark.createDataFrame([("10.1.0.0/16",), ("10.1.2.0/24",), ("fd00::/64",)], "n string").select("n", net.parse(F.col("n")).alias("net"))
    got = networks.address_network_join(ips, nets, "ip", "net").select("t", "n")
    assert rows(got) == [("10.1.2.3", "10.1.0.0/16"), ("10.1.2.3", "10.1.2.0/24"), ("10.1.9.9", "10.1.0.0/16"), ("fd00::5", "fd00::/64")]


def test_samples_are_stable_and_sized(spark):
    df = spark.range(20000)
    a, b = (relational.bernoulli(df, 10, 4, ["id"]) for _ in range(2))
    assert rows(a) == rows(b) and 1700 < a.count() < 2300
    assert rows(relational.bernoulli(df, 0, 4, ["id"])) == [] and relational.bernoulli(df, 100, 4, ["id"]).count() == 20000
    assert relational.reservoir(df, 50, 1, ["id"]).count() == 50


def test_feed_options(spark):
    c = spark.createDataFrame([(7, 1, "I", 3, "it's")], "xid int, seq int, op string, id int, note string")
    f = changes.feed_texts(c, "public.t", ["id"], ["id", "note"], "op", "xid", "seq", include_xids=False, skip_empty=False, all_xids=spark.createDataFrame([(8,)], "xid int"))
    assert [r.data for r in f.orderBy("xid", "part", "seq").collect()] == ["BEGIN", "table public.t: INSERT: id[int]:3 note[string]:'it''s'", "COMMIT", "BEGIN", "COMMIT"]
