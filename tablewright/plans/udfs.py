"""User-defined functions and prepared statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tablewright.functions import user
from tablewright.plans.registry import query


@query("sql_scalar_function", "2.24.1", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 3) AS charge FROM lineitem GROUP BY 1")
def sql_scalar_function(t):
    user.create_sql_function(t.spark, "tw_charge", "price DOUBLE, discount DOUBLE, tax DOUBLE", "DOUBLE", "price * (1 - discount) * (1 + tax)")
    return t.sql("SELECT l_returnflag, round(sum(tw_charge(l_extendedprice, l_discount, l_tax)), 3) AS charge FROM {lineitem} GROUP BY 1")


@query(
    "sql_table_function", "2.24.2 2.1.4",
    "SELECT n_nationkey, q, n_nationkey * q AS product FROM (SELECT c_nationkey AS n_nationkey FROM customer GROUP BY 1), (SELECT unnest([1, 2, 3]) AS q)",
)
def sql_table_function(t):
    user.create_table_function(t.spark, "tw_multiples", "k INT", "q INT, product INT", "SELECT q, k * q FROM VALUES (1), (2), (3) AS v(q)")
    return t.sql("SELECT n_nationkey, m.q, m.product FROM (SELECT c_nationkey AS n_nationkey FROM {customer} GROUP BY 1), LATERAL tw_multiples(n_nationkey) AS m")


@query("python_scalar_function", "2.24.3", "SELECT c_custkey, round(c_acctbal * pow(1 + c_nationkey / 100, 3), 4) AS later, CASE WHEN c_nationkey > 12 THEN round(pow(1 + c_nationkey / 100, 3), 6) END AS factor FROM customer")
def python_scalar_function(t):
    rate = F.col("c_nationkey") / 100
    some = F.when(F.col("c_nationkey") > 12, rate)
    return t.customer.select(
        "c_custkey", F.round(F.col("c_acctbal") * user.compound(rate, F.lit(3.0)), 4).alias("later"),
        F.round(user.strict(lambda r: user.compound(r, F.lit(3.0)), some), 6).alias("factor"),
    )


@query(
    "python_table_function", "2.24.4",
    "SELECT word, place::INTEGER AS place, count(*) AS n FROM (SELECT unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT string_split(p_name, ' ') AS w FROM part)) GROUP BY ALL",
)
def python_table_function(t):
    t.spark.udtf.register("tw_split_words", user.SplitWords)
    # distinct names only: the Python side sees each name once
    names = t.part.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return t.sql("SELECT s.word, s.place, sum(n) AS n FROM {names}, LATERAL tw_split_words(p_name) AS s GROUP BY 1, 2", names=names)


@query("prepared_query", "2.24.9", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def prepared_query(t):
    name = f"tw_prepared_orders_{uuid.uuid4().hex}"  # two runs in one session do not meet
    t.orders.createOrReplaceTempView(name)
    text = f"SELECT o_orderkey, o_totalprice FROM {name} WHERE o_totalprice > :floor AND o_orderstatus = :status AND array_contains(:urgent, o_orderpriority)"
    return t.spark.sql(text, args={"floor": 300000, "status": "F", "urgent": F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))})
