"""Views that are written to."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators.views import View


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "a", 5), (2, "b", 50), (3, None, 500), (4, "a", None), (5, "b", 60)], "id int, kind string, price int")


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_rows_and_nulls(items):
    v = View(items, F.col("price") >= 50, {"key": "id", "double": F.col("price") * 2})
    assert found(v.rows()) == [(2, 100), (3, 1000), (5, 120)]
    assert found(View(v, F.col("double") > 100).rows()) == [(3, 1000), (5, 120)]
    assert View(items.limit(0)).update({"kind": F.lit("x")}).table.count() == 0


def test_update_reaches_visible_rows_only(items):
    change = View(items, F.col("kind") == "b").update({"price": F.col("price") + 1, "kind": F.concat("kind", F.lit("!"))}, F.col("id") < 5)
    assert found(change.table) == [(1, "a", 5), (2, "b!", 51), (3, None, 500), (4, "a", None), (5, "b", 60)]
    assert found(change.returning) == [(2, "b!", 51)]
    # values come from the old row, and a NULL condition is none
    swapped = View(items, columns={"x": "id", "y": "price"}).update({"x": F.col("y"), "y": F.col("x")}, F.col("y") > 50)
    assert found(swapped.table) == [(1, "a", 5), (2, "b", 50), (4, "a", None), (500, None, 3), (60, "b", 5)]


def test_delete_and_insert(spark, items):
    v = View(View(items, F.col("kind") == "b", {"k": "id", "cost": "price"}), F.col("cost") > 50)
    assert found(v.delete().table) == [(1, "a", 5), (2, "b", 50), (3, None, 500), (4, "a", None)]
    assert found(v.delete(F.col("k") > 9).returning) == []
    new = spark.createDataFrame([(9, 7)], "k int, cost int")
    assert found(v.insert(new).table.filter("id > 5")) == [(9, None, 7)]
    assert found(v.insert(new, {"kind": F.lit("c")}).table.filter("id > 5")) == [(9, "c", 7)]
    assert found(v.insert(new).returning) == [(9, 7)]


@pytest.mark.parametrize("inner, outer, cost, kind, passes", [
    (None, None, 1, "z", True), (None, "local", 60, "z", True), (None, "local", 1, "b", False), (None, "cascaded", 60, "z", False), (None, "cascaded", 60, "b", True),
    ("local", None, 1, "b", True), ("local", None, 60, "z", False), ("local", "local", 60, "z", False),
])
def test_check_options(spark, items, inner, outer, cost, kind, passes):
    v = View(View(items, F.col("kind") == "b", check=inner), F.col("price") > 50, check=outer)
    writes = [
        lambda: v.insert(spark.createDataFrame([(9, kind, cost)], "id int, kind string, price int")).table,
        lambda: v.update({"kind": F.lit(kind), "price": F.lit(cost)}).table,
    ]
    for write in writes:
        if passes:
            assert (cost, kind) in {(r.price, r.kind) for r in write().collect()}
        else:
            with pytest.raises(Exception, match="check option"):
                write().collect()


def test_rows_out_of_reach_are_not_checked(items):
    v = View(items, F.col("kind") == "b", check="cascaded")
    assert v.update({"price": F.lit(1)}).table.filter("price = 1").count() == 2


def test_faults(spark, items):
    v = View(items, columns={"k": "id", "twice": F.col("price") * 2})
    for wrong in (lambda: v.update({"twice": F.lit(1)}), lambda: v.insert(spark.range(1).toDF("twice")), lambda: v.update({"price": F.lit(1)}), lambda: View(items, check="all")):
        with pytest.raises(ValueError):
            wrong()


def test_view_queries_can_run_twice_in_a_session(spark):
    from tablewright.plans import load_all

    small, large = (load_all()["views"].run(spark, f"/root/testdata/{sf}") for sf in ("sf0.001", "sf0.01"))
    assert small.count() < large.count()
