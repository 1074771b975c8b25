"""Import, export and foreign files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators import dml
from tablewright.plans.registry import query
from tablewright.session import scratch_path
from tablewright.sources import files, foreign
from tablewright.sources.tables import NAMES


@query(
    "csv_export_import", "2.1.8 2.1.9",
    """
    SELECT doc_id, md5(text) AS digest, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END AS lang, n_chars FROM documents
    """,
)
def csv_export_import(t):
    rows = t.documents.select("doc_id", "text", F.expr("if(doc_id % 7 = 0, null, if(doc_id % 7 = 1, '', lang))").alias("lang"), "n_chars")
    path = scratch_path(t.spark, "csv")
    files.export_csv(rows, path, delimiter="|")
    back = files.import_csv(t.spark, path, rows.schema, delimiter="|")
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("copy_changed_rows", "2.1.10 2.20.4", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def copy_changed_rows(t):
    poor = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = dml.delete(t.orders, ["o_custkey"], poor).returning.select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(t.spark, "copydml")
    files.export_csv(gone, path)
    return files.import_csv(t.spark, path, gone.schema)


@query(
    "foreign_csv_table", "2.1.11",
    """
    SELECT 'good' AS kind, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 'bad', count(*), NULL FROM part WHERE p_partkey % 11 = 0
    """,
)
def foreign_csv_table(t):
    path = scratch_path(t.spark, "foreign")
    size = F.when(F.col("p_partkey") % 11 == 0, F.lit("large")).otherwise(F.col("p_size").cast("string"))
    t.part.select(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", size)).write.text(path)
    schema = T.StructType.fromDDL("p_partkey bigint, p_brand string, p_size int")
    good, bad = files.split_bad_rows(files.foreign_csv(t.spark, path, schema))
    a = good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("size"))
    return a.unionByName(bad.agg(F.lit("bad").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("size")))


@query("foreign_csv_view", "2.1.11", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM supplier WHERE s_acctbal > 100 GROUP BY 1")
def foreign_csv_view(t):
    path = scratch_path(t.spark, "foreignview")
    files.export_csv(t.supplier, path)
    files.register_foreign_csv(t.spark, "tw_foreign_supplier", path, t.supplier.schema)
    return t.spark.sql("SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal), 2) AS balance FROM tw_foreign_supplier WHERE s_acctbal > 100 GROUP BY 1")


@query("schema_import", "2.1.14", " UNION ALL ".join(f"SELECT '{n}' AS tab, (SELECT count(*) FROM (DESCRIBE {n}))::INTEGER AS cols, count(*) AS n FROM {n}" for n in NAMES))
def schema_import(t):
    tables = foreign.import_schema(t.spark, t.folder, NAMES)
    counts = [df.agg(F.lit(n).alias("tab"), F.lit(len(df.columns)).alias("cols"), F.count(F.lit(1)).alias("n")) for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query(
    "json_export", "2.1.16 2.13.11",
    "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
)
def json_export(t):
    path = scratch_path(t.spark, "json")
    t.customer.select("c_custkey", "c_mktsegment", "c_acctbal").write.json(path)
    return t.spark.read.schema("c_custkey bigint, c_mktsegment string, c_acctbal double").json(path)
