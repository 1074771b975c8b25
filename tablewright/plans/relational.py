"""Scans, predicates, sorting, limits, sampling, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import predicates as pr
from tablewright.functions import strings
from tablewright.operators import ordered, relational
from tablewright.plans.registry import query


@query(
    "scan_children", "2.1.2 2.20.17",
    """
    SELECT kind, nation, count(*) AS n, round(sum(balance), 2) AS balance FROM (
      SELECT 'person' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer
      UNION ALL SELECT 'firm', s_nationkey, s_acctbal FROM supplier) GROUP BY ALL
    """,
)
def scan_children(t):
    parent = t.customer.select(F.lit("person").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    child = t.supplier.select(F.lit("firm").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    both = relational.with_children(parent, child)
    return both.groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query(
    "function_scan", "2.1.4 2.8.9 2.8.10",
    """
    SELECT doc_id, i::INTEGER AS ordinality, line FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    """,
)
def function_scan(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).alias("ordinality"), "line"
    )


@query(
    "rows_from_functions", "2.1.4 2.8.9",
    """
    SELECT c_custkey, i::INTEGER AS i, a, b FROM (
      SELECT c_custkey, unnest(range(1, 4)) AS i, unnest([c_name, c_mktsegment, NULL]) AS a, unnest([c_nationkey, NULL, NULL]) AS b FROM customer)
    """,
)
def rows_from_functions(t):
    # parallel arrays of unequal length: the short one is padded with NULL
    return t.customer.select(
        "c_custkey", F.posexplode(F.arrays_zip(F.array("c_name", "c_mktsegment", F.lit(None)).alias("a"), F.array("c_nationkey").alias("b"))).alias("p", "z")
    ).select("c_custkey", (F.col("p") + 1).alias("i"), F.col("z.a").alias("a"), F.col("z.b").alias("b"))


@query(
    "series_int_time", "2.1.5 2.1.6 2.1.7",
    """
    SELECT d.day, coalesce(n, 0) AS n FROM
      (SELECT strftime(unnest(generate_series(lo, hi, INTERVAL 1 DAY)), '%Y-%m-%d') AS day FROM (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders)) d
      LEFT JOIN (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1) o ON d.day = o.day
    UNION ALL
    SELECT 'key ' || k, count(n_nationkey) FROM (SELECT unnest(generate_series(0, 30, 3)) AS k) LEFT JOIN nation ON n_nationkey = k GROUP BY k
    """,
)
def series_int_time(t):
    span = t.orders.agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    days = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    n = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    dense = days.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    keys = t.spark.range(0, 31, 3).withColumnRenamed("id", "k").join(t.nation, F.col("k") == F.col("n_nationkey"), "left")
    return dense.unionByName(keys.groupBy("k").agg(F.count("n_nationkey").alias("n")).select(F.concat(F.lit("key "), "k").alias("day"), "n"))


@query(
    "boolean_tests", "2.2.3 2.2.4 2.2.5",
    """
    SELECT (x > 100000) IS TRUE AS t, (x > 100000) IS NOT TRUE AS nt, (x > 100000) IS FALSE AS f, (x > 100000) IS NULL AS u,
           x IS DISTINCT FROM y AS diff, count(*) AS n
    FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS x, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS y FROM orders)
    GROUP BY ALL
    """,
)
def boolean_tests(t):
    x = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    y = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    big = x > 100000
    return t.orders.groupBy(
        pr.is_true(big).alias("t"), pr.is_not_true(big).alias("nt"), pr.is_false(big).alias("f"), pr.is_unknown(big).alias("u"),
        pr.is_distinct_from(x, y).alias("diff"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "null_counts", "2.2.6 2.2.14",
    """
    SELECT o_orderkey, (a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER AS nulls,
           3 - ((a IS NULL)::INTEGER + (b IS NULL)::INTEGER + (c IS NULL)::INTEGER) AS nonnulls,
           coalesce(a, b, c) AS first_known, greatest(a, b, c) AS top, least(a, b, c) AS low,
           CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS word
    FROM (SELECT o_orderkey, o_orderstatus, nullif(o_orderkey % 2, 0) AS a, nullif(o_custkey % 3, 0) AS b,
                 CASE WHEN o_totalprice > 200000 THEN o_custkey END AS c FROM orders)
    """,
)
def null_counts(t):
    o = t.orders.select(
        "o_orderkey", "o_orderstatus", F.nullif(F.col("o_orderkey") % 2, F.lit(0)).alias("a"),
        F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("b"), F.when(F.col("o_totalprice") > 200000, F.col("o_custkey")).alias("c"),
    )
    abc = [F.col(c) for c in "abc"]
    return o.select(
        "o_orderkey", pr.num_nulls(*abc).alias("nulls"), pr.num_nonnulls(*abc).alias("nonnulls"), F.coalesce(*abc).alias("first_known"),
        F.greatest(*abc).alias("top"), F.least(*abc).alias("low"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("part").alias("word"),
    )


@query(
    "between_in_any_all", "2.2.7 2.2.8 2.2.9 2.2.10",
    """
    SELECT p_partkey, p_size BETWEEN 10 AND 20 AS b, p_size BETWEEN 10 AND 20 AS sym, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS inlist,
           p_size = 5 OR p_size = 7 AS any_eq, p_size > 5 AND p_size > 7 AS all_gt,
           (p_size, p_partkey) < (25, 500) AS row_lt
    FROM part
    """,
)
def between_in_any_all(t):
    arr = F.array(F.lit(5), F.lit(7))
    size = F.col("p_size")
    return t.part.select(
        "p_partkey", size.between(10, 20).alias("b"), pr.between_symmetric(size, F.lit(20), F.lit(10)).alias("sym"),
        F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3").alias("inlist"),
        pr.any_of(arr, lambda x: size == x).alias("any_eq"), pr.all_of(arr, lambda x: size > x).alias("all_gt"),
        F.expr("struct(p_size, p_partkey) < struct(25, 500L)").alias("row_lt"),
    )


@query(
    "pattern_predicates", "2.2.11 2.2.12 2.2.13",
    """
    SELECT p_partkey, p_name LIKE '%bolt' AS lk, p_name NOT LIKE 's%' AS nlk, p_type ILIKE 'eco%y' AS ilk,
           p_brand LIKE 'Brand##1_' ESCAPE '#' AS esc, regexp_full_match(p_name, '(red|blue) (bolt|gear)') AS sim,
           regexp_matches(p_name, '^[a-m]+ ') AS re, regexp_matches(p_type, 'small|promo', 'i') AS rei
    FROM part
    """,
)
def pattern_predicates(t):
    name, kind = F.col("p_name"), F.col("p_type")
    return t.part.select(
        "p_partkey", name.like("%bolt").alias("lk"), (~name.like("s%")).alias("nlk"), kind.ilike("eco%y").alias("ilk"),
        F.expr("p_brand LIKE 'Brand##1_' ESCAPE '#'").alias("esc"), strings.similar_to(name, "(red|blue) (bolt|gear)").alias("sim"),
        name.rlike("^[a-m]+ ").alias("re"), kind.rlike("(?i)small|promo").alias("rei"),
    )


@query(
    "casts_and_domains", "2.2.15 2.2.16",
    """
    SELECT ok, count(*) AS n, CAST(sum(num) AS BIGINT) AS num FROM (
      SELECT coalesce(TRY_CAST(substr(p_brand, 7) AS INTEGER) BETWEEN 1 AND 20, false) AS ok, CAST(p_retailprice AS BIGINT) * 0 + TRY_CAST(substr(p_brand, 7) AS INTEGER) AS num FROM part)
    GROUP BY 1
    """,
)
def casts_and_domains(t):
    number = F.substring("p_brand", 7, 10).try_cast("int").alias("num")
    good, bad = relational.domain_check(t.part.select(number), F.col("num").between(1, 20))
    tag = lambda df, ok: df.agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("num")).select(F.lit(ok).alias("ok"), "n", "num").filter("n > 0")
    return tag(good, True).unionByName(tag(bad, False))


@query(
    "collation_and_citext", "2.2.17 2.19.4",
    """
    SELECT lower(w) AS word, count(*) AS n, count(DISTINCT w) AS spellings,
           CAST(sum((upper(w) = 'THE')::INTEGER) AS BIGINT) AS hits
    FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1
    """,
)
def collation_and_citext(t):
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    # spellings are counted once each before the case-blind grouping
    forms = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("ci", F.collate("w", "UTF8_LCASE"))
    return forms.groupBy("ci").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"), F.sum(F.expr("if(ci = 'the', n, 0)")).alias("hits"),
        F.min(F.lower("w")).alias("word"),
    ).select(F.lower(F.collate("word", "UTF8_BINARY")).alias("word"), "n", "spellings", "hits")


@query(
    "row_security_view", "2.2.18 2.20.9",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000",
)
def row_security_view(t):
    rules = {t.spark.sql("SELECT current_user()").first()[0]: "c_mktsegment = 'BUILDING'"}
    return relational.row_filtered(t.customer, rules).filter("c_acctbal > 1000").select("c_custkey", "c_name")


@query(
    "sort_nulls", "2.6.1 2.6.4",
    """
    SELECT CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, o_orderkey DESC) AS INTEGER) AS place, o_orderkey, k
    FROM (SELECT o_orderkey, nullif(o_custkey % 50, 7) AS k FROM orders)
    """,
)
def sort_nulls(t):
    o = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 50, F.lit(7)).alias("k"))
    halves = o.filter("o_orderkey % 2 = 0").unionByName(o.filter("o_orderkey % 2 = 1"))
    return ordered.number_rows(halves, [], ["k", "-o_orderkey"], "place").select(F.col("place").cast("int").alias("place"), "o_orderkey", "k")


@query(
    "top_k_offset", "2.6.2 2.6.3",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25 OFFSET 10",
)
def top_k_offset(t):
    rows = t.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.offset(10).limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("distinct_rows", "2.6.5", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "distinct_on", "2.6.6",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
)
def distinct_on(t):
    return ordered.first_per_key(t.orders, ["o_custkey"], ["-o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("sample_bernoulli", "2.6.7")
def sample_bernoulli(t):
    return relational.bernoulli(t.lineitem, 10.0, seed=5, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("sample_system", "2.6.8")
def sample_system(t):
    return relational.system_sample(t.orders, 50.0, seed=3)


@query("sample_rows", "2.6.9 2.6.10")
def sample_rows(t):
    return relational.reservoir(t.orders, 100, seed=9, key=["o_orderkey"])


@query(
    "cursor_pages", "2.6.11",
    """
    SELECT (position - 1) // 20 AS page, position, o_orderkey, o_totalprice FROM (
      SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice NULLS LAST, o_orderkey) AS position FROM (
        SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders))
    """,
)
def cursor_pages(t):
    # every page to the end, in one pass; some keys are NULL
    priced = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    cursor = relational.Cursor(priced, ["o_totalprice", "o_orderkey"])
    return cursor.fetch_numbered("forward", "all").select(F.expr("(position - 1) div 20").alias("page"), "position", "o_orderkey", "o_totalprice")


#: Direction, number, and the positions that it gives, in SQL over ``n`` rows.
SCROLLS = [
    ("forward", 5, "p BETWEEN 1 AND 5"), ("backward", 3, "p BETWEEN 2 AND 4"), ("absolute", -1, "p = n"), ("relative", -10, "p = n - 10"), ("prior", None, "p = n - 11"),
    ("last", None, "p = n"), ("next", None, "false"), ("backward", 7, "p BETWEEN n - 6 AND n"), ("first", None, "p = 1"), ("prior", None, "false"), ("absolute", 700, "p = 700"),
    ("forward", 0, "p = 700"), ("backward", "all", "p < 700"), ("forward", 2, "p BETWEEN 1 AND 2"), ("forward", "all", "p > 2"),
]


@query(
    "cursor_scroll", "2.6.11",
    """
    WITH o AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey) AS p, count(*) OVER () AS n FROM orders)
    """ + " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, p AS position, o_orderkey FROM o WHERE {where}" for i, (_, _, where) in enumerate(SCROLLS)),
)
def cursor_scroll(t):
    cursor, out = relational.Cursor(t.orders.select("o_orderkey", "o_orderdate"), ["-o_orderdate", "o_orderkey"]), None
    for i, (direction, n, _) in enumerate(SCROLLS):
        part = cursor.fetch_numbered(direction, n).select(F.lit(i).alias("step"), "position", "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "group_by_ordinal_alias", "2.6.12",
    "SELECT year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, count(*) AS n FROM orders GROUP BY 1, 2",
)
def group_by_ordinal_alias(t):
    return t.sql("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY 1, m ORDER BY 3 DESC, y")


@query(
    "set_operations", "2.7.1 2.7.2 2.7.3 2.7.4",
    """
    WITH a AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT s_nationkey AS k FROM supplier)
    SELECT 'union all' AS op, k, count(*) AS n FROM (SELECT k FROM a UNION ALL SELECT k FROM b) GROUP BY k
    UNION ALL SELECT 'union', k, count(*) FROM (SELECT k FROM a UNION SELECT k FROM b) GROUP BY k
    UNION ALL SELECT 'intersect', k, count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) GROUP BY k
    UNION ALL SELECT 'intersect all', k, count(*) FROM (SELECT k FROM a INTERSECT ALL SELECT k FROM b) GROUP BY k
    UNION ALL SELECT 'except', k, count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b WHERE k < 10) GROUP BY k
    UNION ALL SELECT 'except all', k, count(*) FROM (SELECT k FROM a EXCEPT ALL SELECT k FROM b) GROUP BY k
    """,
)
def set_operations(t):
    a = t.customer.filter("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    b = t.supplier.select(F.col("s_nationkey").alias("k"))
    results = {
        "union all": a.unionAll(b), "union": a.union(b).distinct(), "intersect": a.intersect(b),
        "intersect all": relational.intersect_all(a, b), "except": a.subtract(b.filter("k < 10")), "except all": relational.except_all(a, b),
    }
    out = None
    for op, df in results.items():
        part = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "k", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "set_type_promotion", "2.7.5",
    """
    SELECT v, count(*) AS n FROM (SELECT p_size::DOUBLE AS v FROM part UNION ALL SELECT round(p_retailprice / 100, 0) FROM part
      UNION ALL SELECT s_suppkey::DOUBLE FROM supplier) GROUP BY 1
    """,
)
def set_type_promotion(t):
    ints = t.part.select(F.col("p_size").alias("v"))
    doubles = t.part.select(F.round(F.col("p_retailprice") / 100, 0).alias("v"))
    longs = t.supplier.select(F.col("s_suppkey").alias("v"))
    return ints.union(doubles).union(longs).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
