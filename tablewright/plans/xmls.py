"""XML built from and read back out of table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import xmlx
from tablewright.plans.registry import query


def part_docs(t):
    """One document per part: its name as numbered words, its brand and size."""
    words = F.transform(
        F.split("p_name", " "), lambda w, i: F.concat(F.lit('<w n="'), (i + 1).cast("string"), F.lit('">'), xmlx.escape(w), F.lit("</w>"))
    )
    body = F.concat(F.array_join(words, ""), xmlx.element("brand", xmlx.escape(F.col("p_brand"))))
    return t.spread("part", "p_partkey").select("p_partkey", xmlx.element("part", body, id=F.col("p_partkey"), size=F.col("p_size")).alias("doc"))


@query(
    "xml_paths", "2.17.1",
    """
    SELECT p_partkey, p_partkey::VARCHAR AS id, len(string_split(p_name, ' '))::INTEGER AS n, p_size > 45 AS big, CAST(list_sum(range(1, len(string_split(p_name, ' ')) + 1)) AS DOUBLE) AS total,
           replace(p_name, ' ', ',') AS words, p_brand AS brand FROM part
    """,
)
def xml_paths(t):
    doc = F.col("doc")
    return part_docs(t).select(
        "p_partkey", F.xpath_string(doc, F.lit("/part/@id")).alias("id"), F.xpath_int(doc, F.lit("count(/part/w)")).alias("n"),
        xmlx.exists(doc, "/part[@size > 45]").alias("big"), F.xpath_number(doc, F.lit("sum(/part/w/@n)")).alias("total"),
        F.array_join(F.xpath(doc, F.lit("/part/w/text()")), ",").alias("words"), F.xpath_string(doc, F.lit("/part/brand")).alias("brand"),
    )


@query(
    "xml_table", "2.17.2",
    "SELECT p_partkey, n::VARCHAR AS n, word FROM (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part))",
)
def xml_table(t):
    cols = {"n": "/part/w/@n", "word": "/part/w/text()"}
    arrays = [F.xpath("doc", F.lit(p)).alias(c) for c, p in cols.items()]
    return part_docs(t).select("p_partkey", F.inline(F.arrays_zip(*arrays)))


@query(
    "xml_construction", "2.17.3",
    """
    SELECT c_custkey, '<cust id="' || c_custkey || '"><c_name>' || c_name || '</c_name>' || CASE WHEN c_nationkey > 12 THEN '<seg>' || c_mktsegment || '</seg>' ELSE '' END || '</cust>' AS x,
           '<?xml version="1.0"?><?go now?><e/>' AS root, '<a t="&lt;' || c_mktsegment || '&gt; &amp; &quot;x&quot;"/>' AS esc, '<!--' || c_name || '-->' AS note FROM customer
    """,
)
def xml_construction(t):
    seg = F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment"))
    odd = F.concat(F.lit("<"), F.col("c_mktsegment"), F.lit('> & "x"'))
    return t.customer.select(
        "c_custkey", xmlx.element("cust", xmlx.forest(c_name=F.col("c_name"), seg=seg), id=F.col("c_custkey")).alias("x"),
        xmlx.root(xmlx.concat(xmlx.instruction("go", F.lit("now")), xmlx.element("e"))).alias("root"), xmlx.element("a", t=odd).alias("esc"),
        xmlx.comment(F.col("c_name")).alias("note"),
    )


@query(
    "xml_well_formed", "2.17.4",
    "SELECT p_partkey, p_size % 3 <> 0 AS ok FROM part",
)
def xml_well_formed(t):
    good = xmlx.element("p", xmlx.escape(F.col("p_name")))
    doc = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("<p><q>"), F.col("p_name"), F.lit("</p>"))).otherwise(good)
    return t.part.select("p_partkey", xmlx.is_well_formed(doc).alias("ok"))


@query(
    "xml_table_export", "2.17.5 2.1.16",
    "SELECT n_nationkey, '<row><n_nationkey>' || n_nationkey || '</n_nationkey><n_name>' || n_name || '</n_name><customers>' || n || '</customers></row>' AS x FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey",
)
def xml_table_export(t):
    n = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    rows = t.nation.join(n, "n_nationkey")
    return rows.select("n_nationkey", xmlx.table_rows("row", ["n_nationkey", "n_name", "customers"]).alias("x"))


@query("html_titles", "2.17.1", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_titles(t):
    return t.pages.select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")
    )
