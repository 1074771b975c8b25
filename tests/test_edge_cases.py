"""Cases that once gave a wrong answer without an error."""

import datetime

from pyspark.sql import functions as F

from tablewright.functions import aggregates, jsonx
from tablewright.operators import dml, ordered, skipping
from tablewright.operators.relational import Cursor
from tablewright.plans import load_all
from tablewright.sources import files
from tablewright.streaming import changes


def test_groups_of_nulls_stay(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), ("b", None)], "k string, v double")
    for kind in ("cont", "disc"):
        got = {r.k: r.p for r in ordered.exact_percentiles(df, ["k"], "v", {"p": 0.5}, kind).collect()}
        assert got == {"a": 2.0 if kind == "cont" else 1.0, "b": None}
    assert {r.k: r["mode"] for r in ordered.modes(df, ["k"], "v").collect()} == {"a": 1.0, "b": None}


def test_intervals_add_up_beyond_the_longest_interval(spark):
    rows = [("a", datetime.timedelta(days=100_000_000)), ("a", datetime.timedelta(days=100_000_000, microseconds=3)), ("b", datetime.timedelta(seconds=-61.5)), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, w interval day to second")
    got = {r.k: (r.s, r.m) for r in df.groupBy("k").agg(aggregates.interval_sum(F.col("w")).alias("s"), aggregates.interval_avg(F.col("w")).alias("m")).collect()}
    day = 86_400_000_000
    assert got == {"a": (200_000_000 * day + 3, 100_000_000 * day + 2), "b": (-61_500_000, -61_500_000), "c": (None, None)}


def test_interval_aggregates_of_large_groups(spark, tmp_path):
    # 40 lines of over 3,000,000 days each, more than an interval holds
    start, end = datetime.datetime(1601, 1, 1), datetime.datetime(9999, 12, 30)
    wait = (end - start).days
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit(start).alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.range(40).select(F.col("id").alias("l_orderkey"), F.lit("R").alias("l_returnflag"), F.lit(end).alias("l_shipdate"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    row = load_all()["interval_aggregates"].run(spark, str(tmp_path)).first()
    assert 40 * wait > 106_751_991 and tuple(row) == ("R", 40 * wait, wait * 86_400)


def test_cursor_passes_null_keys(spark):
    rows = [(None, 1), (None, 2), (None, 3), (1, 4), (2, 5)]
    cursor = Cursor(spark.createDataFrame(rows, "a int, b int"), ["a", "b"])
    pages = [[r.b for r in cursor.fetch(2).collect()] for _ in range(4)]
    assert pages == [[4, 5], [1, 2], [3], []]


def test_json_arrays_have_their_strings(spark):
    df = spark.createDataFrame([('["a","b",1]',), ('{"a":1}',)], "j string")
    got = df.select(jsonx.has_key(F.col("j"), "b").alias("k"), jsonx.has_any(F.col("j"), ["a", "z"]).alias("any"), jsonx.has_all(F.col("j"), ["a", "b"]).alias("all")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False)]


def test_json_object_keeps_repeated_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ('q"', None)], "k string, v int")
    assert df.agg(aggregates.json_object_agg(F.col("k"), F.col("v")).alias("j")).first().j == '{"a":1,"a":2,"q\\"":null}'


def test_quotes_of_feeds_and_notices(spark):
    df = spark.createDataFrame([("o'x", "I", 1, datetime.date(2020, 1, 2))], "k string, op string, n int, d date")
    assert dml.notifications(df, "t", ["k"]).first().payload == "\"t\",I,\"k\"='o''x'"
    lines = changes.feed_texts(df, "t", ["k"], ["k", "n", "d"], "op", "n", "n").filter("part = 1").first().data
    assert lines == "table t: INSERT: k[string]:'o''x' n[int]:1 d[date]:'2020-01-02'"


def test_empty_histogram():
    assert skipping.predicate_buckets([], "=", 1.0) == [skipping.OUTSIDE]
    assert skipping.predicate_buckets([], "between", 1.0, 2.0) == [skipping.OUTSIDE]


def test_csv_keeps_empty_null_and_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a\nb"), (4, 'q"x,\r\ny'), (5, " z ")], "id int, s string")
    for quoted in (False, True):
        path = str(tmp_path / f"csv{quoted}")
        files.export_csv(df, path, force_quote=quoted)
        assert sorted(map(tuple, files.import_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_json_paths_through_arrays(spark):
    L, j = F.lit, F.lit('{"a":[1,2,{"b":3}]}')
    cases = [
        (jsonx.set_path(j, ["a", "0"], L("9")), '{"a":[9,2,{"b":3}]}'),
        (jsonx.set_path(j, ["a", "-1", "b"], L("9")), '{"a":[1,2,{"b":9}]}'),
        (jsonx.set_path(j, ["a", "7"], L("9")), '{"a":[1,2,{"b":3},9]}'),
        (jsonx.set_path(j, ["a", "-7"], L("9")), '{"a":[9,1,2,{"b":3}]}'),
        (jsonx.set_path(j, ["a", "7"], L("9"), False), '{"a":[1,2,{"b":3}]}'),
        (jsonx.set_path(j, ["a", "0", "x"], L("9")), '{"a":[1,2,{"b":3}]}'),
        (jsonx.insert_path(j, ["a", "1"], L("9")), '{"a":[1,9,2,{"b":3}]}'),
        (jsonx.insert_path(j, ["a", "2", "c"], L("9")), '{"a":[1,2,{"b":3,"c":9}]}'),
        (jsonx.delete_path(j, ["a", "-2"]), '{"a":[1,{"b":3}]}'),
        (jsonx.delete_path(j, ["a", "2", "b"]), '{"a":[1,2,{}]}'),
        (jsonx.delete_path(j, ["a", "x"]), '{"a":[1,2,{"b":3}]}'),
    ]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(got) == [x for _, x in cases]


def test_stems_of_all_documents(spark, tmp_path):
    rows = [(1, "running", "en"), (2, "coureurs", "fr"), (3, "letters", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = load_all()["fts_stems"].run(spark, str(tmp_path)).collect()
    assert {r.word: r.stem for r in got} == {"running": "run", "coureurs": "coureur", "letters": "letter"}
