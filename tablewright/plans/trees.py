"""Label paths: region.nation.segment.customer and part hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import labelpath as lp
from tablewright.plans.registry import query

PATHS = "(SELECT c_custkey, r_name || '.' || n_name || '.' || c_mktsegment || '.c' || c_custkey AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def paths(t):
    # nation and region are closed lists of 25 and 5 rows
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.concat_ws(".", "r_name", "n_name", "c_mktsegment", F.concat(F.lit("c"), F.col("c_custkey"))).alias("p"))


@query(
    "label_paths", "2.19.1",
    f"""
    SELECT c_custkey, starts_with(p, 'ASIA.') AS under, p = 'ASIA' OR starts_with('ASIA', p || '.') AS over, 4 AS levels, split_part(p, '.', 2) || '.' || split_part(p, '.', 3) AS mid,
           split_part(p, '.', 4) AS last, CASE WHEN p LIKE '%.BUILDING.%' THEN 2 ELSE -1 END AS idx,
           CASE WHEN p LIKE 'ASIA.NATION\\_2.%' ESCAPE '\\' THEN 'ASIA.NATION_2' WHEN p LIKE 'ASIA.%' THEN 'ASIA' ELSE '' END AS lca FROM {PATHS}
    """,
)
def label_paths(t):
    p = F.col("p")
    return paths(t).select(
        "c_custkey", lp.is_descendant(p, F.lit("ASIA")).alias("under"), lp.is_ancestor(p, F.lit("ASIA")).alias("over"), lp.nlevel(p).alias("levels"), lp.subpath(p, 1, 2).alias("mid"),
        lp.subpath(p, -1).alias("last"), lp.index(p, F.lit("BUILDING")).alias("idx"), lp.lca(p, F.lit("ASIA.NATION_2.NONE.x")).alias("lca"),
    )


@query(
    "label_patterns", "2.19.2",
    f"""
    SELECT c_custkey, starts_with(p, 'ASIA.') AND p LIKE '%.BUILDING.%' AS a, split_part(p, '.', 1) IN ('ASIA', 'EUROPE') AS b, split_part(p, '.', 3) <> 'BUILDING' AS c,
           lower(split_part(p, '.', 3)) = 'machinery' AS d, split_part(p, '.', 2) LIKE 'NATION%' AND split_part(p, '.', 3) LIKE 'FURN%' AS e,
           split_part(p, '.', 1) = 'ASIA' AND split_part(p, '.', 3) <> 'BUILDING' AS f, split_part(p, '.', 2) LIKE 'NATION\\_1%' ESCAPE '\\' AND split_part(p, '.', 2) IN ('NATION_1', 'NATION_1_x') AS g FROM {PATHS}
    """,
)
def label_patterns(t):
    p = F.col("p")
    return paths(t).select(
        "c_custkey", lp.matches(p, "ASIA.*.BUILDING.*").alias("a"), lp.matches(p, "ASIA|EUROPE.*{2,}").alias("b"), lp.matches(p, "*{2}.!BUILDING.*").alias("c"),
        lp.matches(p, "*.machinery@.*{1}").alias("d"), lp.matches(p, "*{1}.NATION%.FURN*.*").alias("e"), lp.matches_words(p, "ASIA & !BUILDING").alias("f"),
        lp.matches(p, "*{1}.NATION_1.*").alias("g"),
    )


@query(
    "label_path_arrays", "2.19.3",
    f"""
    SELECT c_custkey, starts_with(p, 'ASIA.') OR starts_with(p, 'EUROPE.NATION_3.') AS any_over,
           CASE WHEN starts_with(p, 'ASIA.') THEN 'ASIA' WHEN starts_with(p, 'EUROPE.NATION_3.') THEN 'EUROPE.NATION_3' END AS first_over, p LIKE '%.BUILDING.%' AS any_like FROM {PATHS}
    """,
)
def label_path_arrays(t):
    p = F.col("p")
    roots = F.array(F.lit("ASIA"), F.lit("EUROPE.NATION_3"))
    return paths(t).select(
        "c_custkey", lp.any_ancestor(roots, p).alias("any_over"), lp.first_ancestor(roots, p).alias("first_over"), lp.any_matches(F.array(p, F.lit("x.y")), "*.BUILDING.*").alias("any_like")
    )
