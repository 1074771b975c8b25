"""Column statistics over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import textsearch as ts
from tablewright.operators import statistics as st
from tablewright.plans.joins import SPANS_SQL, busy_spans
from tablewright.plans.registry import query

COLS = ["l_partkey", "l_linenumber", "l_returnflag", "tax"]
LINE_SQL = "(SELECT l_partkey, l_linenumber, l_returnflag, CASE WHEN l_tax > 0.01 THEN CAST(round(l_tax * 100) AS INTEGER) END AS tax FROM lineitem)"


def line_columns(t):
    return t.lineitem.select("l_partkey", "l_linenumber", "l_returnflag", F.when(F.col("l_tax") > 0.01, F.round(F.col("l_tax") * 100).cast("int")).alias("tax"))


@query(
    "column_profile", "2.22.1",
    " UNION ALL ".join(
        f"SELECT '{c}' AS attname, round(1 - count({c}) / count(*), 9) AS null_frac, round(avg(length({c}::VARCHAR)), 6) AS avg_width, count(DISTINCT {c}) AS n_distinct FROM {LINE_SQL}" for c in COLS
    ),
)
def column_profile(t):
    return st.column_profile(line_columns(t), COLS).select("attname", F.round("null_frac", 9).alias("null_frac"), F.round("avg_width", 6).alias("avg_width"), "n_distinct")


@query("column_profile_sketched", "2.22.1")
def column_profile_sketched(t):
    return st.approximate_profile(line_columns(t), COLS)


@query(
    "most_common_values", "2.22.2",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS attname, {c}::VARCHAR AS v, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS freq FROM {LINE_SQL} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 5)" for c in COLS
    ),
)
def most_common_values(t):
    return st.most_common_values(line_columns(t), COLS, 5).select("attname", "v", F.round("freq", 9).alias("freq"))


def bounds_sql(source: str, column: str, bins: int) -> str:
    return ", ".join(f"quantile_disc({column}, {i / bins}) AS b{i}" for i in range(bins + 1))


@query(
    "equi_depth_histogram", "2.22.3",
    f"""
    WITH top AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey::VARCHAR LIMIT 5)
    SELECT {bounds_sql('', 'l_partkey', 20)} FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM top)
    """,
)
def equi_depth_histogram(t):
    common = st.most_common_values(t.lineitem, ["l_partkey"], 5)
    return st.equi_depth_histogram(t.lineitem, "l_partkey", 20, common)


@query(
    "order_correlation", "2.22.4",
    "SELECT round(corr(r, p), 6) AS correlation FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r FROM orders)",
)
def order_correlation(t):
    return st.order_correlation(t.orders, "o_custkey", ["o_orderkey"]).select(F.round("correlation", 6).alias("correlation"))


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"


@query(
    "most_common_elements", "2.22.5",
    f"SELECT element, round(count(*) / (SELECT count(*) FROM documents), 9) AS freq FROM (SELECT unnest({WORDS}) AS element FROM documents) GROUP BY 1 ORDER BY count(*) DESC, element LIMIT 25",
)
def most_common_elements(t):
    return st.most_common_elements(t.spread("documents", "doc_id"), "doc_id", ts.words(F.col("text")), 25).select("element", F.round("freq", 9).alias("freq"))


@query("element_count_histogram", "2.22.5", f"SELECT {', '.join(f'quantile_disc(n, {i / 10})::INTEGER AS b{i}' for i in range(11))} FROM (SELECT len({WORDS}) AS n FROM documents)")
def element_count_histogram(t):
    return st.element_count_histogram(t.spread("documents", "doc_id"), ts.words(F.col("text")), 10)


@query(
    "range_histograms", "2.22.6",
    f"WITH s AS ({SPANS_SQL}) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, {bounds_sql('', e, 8)} FROM s" for k, e in (("lower", "lo"), ("upper", "hi"), ("length", "hi - lo"))),
)
def range_histograms(t):
    return st.range_histograms(busy_spans(t), "lo", "hi", 8)


PREDICATES = {"low": (0.0, 60000.0), "middle": (100000.0, 250000.0), "high": (400000.0, 900000.0), "none": (-5.0, -1.0)}


@query(
    "selectivity_check", "2.22.7",
    f"""
    WITH b AS (SELECT [{', '.join(f'quantile_disc(o_totalprice, {i / 10})' for i in range(11))}] AS b FROM orders), n AS (SELECT count(*) AS n FROM orders),
    p AS (SELECT unnest({list(PREDICATES)}) AS predicate, unnest({[v[0] for v in PREDICATES.values()]}::DOUBLE[]) AS lo, unnest({[v[1] for v in PREDICATES.values()]}::DOUBLE[]) AS hi),
    f AS (SELECT predicate, lo, hi, b, CASE WHEN hi <= b[1] THEN 0.0 WHEN hi >= b[11] THEN 1.0 ELSE (ih - 1 + (hi - b[ih]) / (b[ih + 1] - b[ih])) / 10 END AS fh,
                 CASE WHEN lo <= b[1] THEN 0.0 WHEN lo >= b[11] THEN 1.0 ELSE (il - 1 + (lo - b[il]) / (b[il + 1] - b[il])) / 10 END AS fl
          FROM (SELECT *, len(list_filter(b, lambda x: x <= hi)) AS ih, len(list_filter(b, lambda x: x <= lo)) AS il FROM p, b))
    SELECT predicate, round(n * greatest(fh + (1 - fl) - 1, 0), 0)::BIGINT AS estimated, (SELECT count(*) FROM orders WHERE o_totalprice >= lo AND o_totalprice < hi) AS actual FROM f, n
    """,
)
def selectivity_check(t):
    row = st.equi_depth_histogram(t.orders, "o_totalprice", 10).first()
    return st.selectivity_report(t.orders, "o_totalprice", list(row), PREDICATES)
