"""JSON, key/value maps and records over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import jsonx
from tablewright.functions import maps
from tablewright.operators import joins
from tablewright.plans.registry import query

# a nested document per order line group, built by both sides in the same text form
DOC_SQL = """(SELECT o_orderkey, '{"id":' || o_orderkey || ',"cust":{"key":' || o_custkey || ',"tier":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"t' || o_custkey % 3 || '"' END
  || '},"tags":["' || o_orderstatus || '","' || o_orderpriority || '",' || o_orderkey % 4 || ']}' AS j FROM orders)"""


def docs(t):
    tier = F.when(F.col("o_custkey") % 3 == 0, F.lit("null")).otherwise(F.format_string('"t%s"', F.col("o_custkey") % 3))
    j = F.format_string(
        '{"id":%s,"cust":{"key":%s,"tier":%s},"tags":["%s","%s",%s]}', F.col("o_orderkey"), F.col("o_custkey"), tier, F.col("o_orderstatus"),
        F.col("o_orderpriority"), F.col("o_orderkey") % 4,
    )
    return t.spread("orders", "o_orderkey").select("o_orderkey", j.alias("j"))


@query(
    "json_access", "2.13.1 2.13.2 2.13.3 2.13.5 2.13.9",
    f"""
    SELECT o_orderkey, (j->'cust')::VARCHAR AS sub, j->'cust'->>'tier' AS tier, (j->'tags'->0)::VARCHAR AS first_json, j->'tags'->>1 AS second, (j->'tags'->-1)::VARCHAR AS last,
           j->>'$.cust.key' AS k, (j->'$.tags[2]')::VARCHAR AS deep, json_array_length(j->'tags')::INTEGER AS n,
           CASE lower(json_type(j, '$.cust.tier')) WHEN 'varchar' THEN 'string' ELSE lower(json_type(j, '$.cust.tier')) END AS kind,
           lower(json_type(j, '$.tags')) AS tags_kind FROM (SELECT o_orderkey, j::JSON AS j FROM {DOC_SQL})
    """,
)
def json_access(t):
    j = F.col("j")
    return docs(t).select(
        "o_orderkey", jsonx.get_path(j, "cust").alias("sub"), jsonx.get_text(j, "cust", "tier").alias("tier"), jsonx.get_path(j, "tags", 0).alias("first_json"),
        jsonx.get_text(j, "tags", 1).alias("second"), jsonx.element_from_end(jsonx.get_path(j, "tags"), -1).alias("last"), jsonx.get_text(j, "cust", "key").alias("k"),
        jsonx.get_path(j, "tags", 2).alias("deep"), F.json_array_length(jsonx.get_path(j, "tags")).alias("n"),
        jsonx.type_of(jsonx.get_path(j, "cust", "tier")).alias("kind"), jsonx.type_of(jsonx.get_path(j, "tags")).alias("tags_kind"),
    )


@query(
    "json_props", "2.13.1",
    "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS k, count(*) AS n FROM events WHERE (props->>'k')::BIGINT > 10 GROUP BY 1",
)
def json_props(t):
    k = jsonx.get_text(F.col("props"), "k").cast("long").alias("k")
    return t.spread("events", "event_id").select("event_type", k).filter("k > 10").groupBy("event_type").agg(F.sum("k").alias("k"), F.count(F.lit(1)).alias("n"))


@query(
    "json_rows", "2.13.4 2.13.6 2.13.7 2.8.11",
    f"""
    SELECT kind, k, v, count(*) AS n FROM (
      SELECT 'key' AS kind, unnest(json_keys(j)) AS k, NULL AS v FROM (SELECT j::JSON AS j FROM {DOC_SQL})
      UNION ALL SELECT 'each', k, (j->'cust'->k)::VARCHAR FROM (SELECT j::JSON AS j, unnest(['key', 'tier']) AS k FROM {DOC_SQL})
      UNION ALL SELECT 'element', NULL, (j->'tags'->i)::VARCHAR FROM (SELECT j::JSON AS j, unnest([0, 1, 2]) AS i FROM {DOC_SQL})) GROUP BY ALL
    """,
)
def json_rows(t):
    d = docs(t)
    none = F.lit(None).cast("string")
    k = d.select(F.lit("key").alias("kind"), F.explode(jsonx.keys(F.col("j"))).alias("k"), none.alias("v"))
    each = d.select(F.lit("each").alias("kind"), F.explode(jsonx.entries(jsonx.get_path(F.col("j"), "cust"))).alias("k", "v"))
    element = d.select(F.lit("element").alias("kind"), none.alias("k"), F.explode(jsonx.elements(jsonx.get_path(F.col("j"), "tags"))).alias("v"))
    return k.unionByName(each).unionByName(element).groupBy("kind", "k", "v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "json_record_set", "2.13.8",
    """
    SELECT c_custkey, seg, bal FROM (SELECT c_custkey, unnest([c_mktsegment, 'x']) AS seg, unnest([c_nationkey::BIGINT, NULL]) AS bal FROM customer)
    """,
)
def json_record_set(t):
    j = F.concat(F.lit('[{"seg":"'), F.col("c_mktsegment"), F.lit('","bal":'), F.col("c_nationkey").cast("string"), F.lit('},{"seg":"x","extra":1}]'))
    return t.customer.select("c_custkey", j.alias("j")).select("c_custkey", F.inline(F.from_json("j", "array<struct<seg:string,bal:bigint>>")))


@query(
    "json_building", "2.13.10 2.13.11 2.13.12 2.1.16",
    """
    SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS r,
           '{"a":' || c_custkey || ',"b":' || CASE WHEN c_nationkey > 12 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}' AS o,
           '[' || c_custkey || ',"' || c_mktsegment || '",' || (c_acctbal > 0)::VARCHAR || ']' AS arr,
           '{"a":' || c_custkey || CASE WHEN c_nationkey > 12 THEN ',"b":"' || c_mktsegment || '"' ELSE '' END || '}' AS stripped,
           '{"k1":"' || c_mktsegment || '","k2":"' || c_name || '"}' AS from_text FROM customer
    """,
)
def json_building(t):
    maybe = F.when(F.col("c_nationkey") > 12, F.col("c_mktsegment"))
    obj = jsonx.build_object(a=F.col("c_custkey"), b=maybe)
    keys = F.array(F.lit("k1"), F.lit("k2"))
    return t.customer.select(
        "c_custkey", F.to_json(F.struct("c_custkey", "c_nationkey", "c_mktsegment")).alias("r"), obj.alias("o"),
        jsonx.build_array(F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal") > 0).alias("arr"), jsonx.strip_nulls(obj).alias("stripped"),
        F.to_json(F.map_from_arrays(keys, F.array("c_mktsegment", "c_name"))).alias("from_text"),
    )


@query(
    "json_containment", "2.13.13 2.13.14 2.13.17",
    f"""
    SELECT o_orderkey, o_custkey % 3 = 1 AS has_tier, o_orderstatus = 'F' AS tag_f, o_orderkey % 4 = 2 AS tag_2, true AS k_id, false AS k_none, true AS k_any, false AS k_all,
           '{{"cust":{{"key":' || o_custkey || ',"tier":' || CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE '"t' || o_custkey % 3 || '"' END || '}},"id":' || o_orderkey
           || ',"tags":["' || o_orderstatus || '","' || o_orderpriority || '",' || o_orderkey % 4 || ']}}' AS canon FROM orders
    """,
)
def json_containment(t):
    j = F.col("j")
    return docs(t).select(
        "o_orderkey", jsonx.contains(j, '{"cust":{"tier":"t1"}}').alias("has_tier"), jsonx.contains(j, '{"tags":["F"]}').alias("tag_f"),
        jsonx.contains(j, '{"tags":[2]}').alias("tag_2"), jsonx.has_key(j, "id").alias("k_id"), jsonx.has_key(j, "zip").alias("k_none"),
        jsonx.has_any(j, ["zip", "tags"]).alias("k_any"), jsonx.has_all(j, ["zip", "tags"]).alias("k_all"), jsonx.canonical(j).alias("canon"),
    )


@query(
    "json_containment_columns", "2.13.13",
    """
    SELECT o_orderkey, true AS whole, o_custkey % 3 = o_orderkey % 3 AND o_orderkey % 3 <> 0 AS tier, o_orderkey % 4 = 1 AND o_orderstatus = 'F' AS tags,
           o_orderkey % 4 = o_orderkey % 5 AS number FROM orders
    """,
)
def json_containment_columns(t):
    j, k = F.col("j"), F.col("o_orderkey")
    asked = docs(t).select(
        k, j, F.concat(F.lit('{"tags":[],"cust":{"key":'), F.get_json_object(j, "$.cust.key"), F.lit("}}")).alias("whole"),
        F.format_string('{"cust":{"tier":"t%s"}}', k % 3).alias("tier"), F.lit('{"tags":[1.0,"F"]}').alias("tags"), F.format_string('{"tags":[%s]}', k % 5).alias("number"),
    )
    return asked.select("o_orderkey", *[jsonx.contains_json(j, F.col(c)).alias(c) for c in ("whole", "tier", "tags", "number")])


@query(
    "json_containment_join", "2.13.13",
    """
    WITH e AS (SELECT DISTINCT '{"k":' || (props->>'k') || ',"t":["' || event_type || '",' || user_id || ']}' AS doc, (props->>'k')::INTEGER AS k, event_type, user_id FROM events),
    q AS (SELECT DISTINCT '{"t":["' || event_type || '"],"k":' || user_id || '}' AS part, event_type, user_id AS k FROM events)
    SELECT doc, part FROM e JOIN q USING (event_type, k)
    """,
)
def json_containment_join(t):
    key, kind, user = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("user_id")
    a = t.events.select(F.format_string('{"k":%s,"t":["%s",%s]}', key, kind, user).alias("doc"))
    b = t.events.select(F.format_string('{"t":["%s"],"k":%s}', kind, user).alias("part"))
    return joins.json_contains_join(a, b, "doc", "part")


@query(
    "json_editing", "2.13.15 2.13.16 2.13.18",
    """
    SELECT c_custkey, '{"a":' || c_custkey || ',"b":"new","c":true}' AS merged, '{"b":{"x":' || c_nationkey || '}}' AS minus_key,
           '{"a":' || c_custkey || ',"b":{"x":99}}' AS set_x, '{"a":' || c_custkey || ',"b":{"x":' || c_nationkey || ',"y":5}}' AS ins_y,
           '{"a":' || c_custkey || ',"b":{}}' AS del_x, '[' || c_custkey || ',3]' AS minus_idx, '{' || chr(10) || '  "a" : ' || c_custkey || chr(10) || '}' AS pretty FROM customer
    """,
)
def json_editing(t):
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    j = F.format_string('{"a":%s,"b":{"x":%s}}', key, nat)
    return t.customer.select(
        "c_custkey", jsonx.concat(j, F.lit('{"b":"new","c":true}')).alias("merged"), jsonx.without_keys(j, "a").alias("minus_key"),
        jsonx.set_path(j, ["b", "x"], F.lit("99")).alias("set_x"), jsonx.insert_path(j, ["b", "y"], F.lit("5")).alias("ins_y"),
        jsonx.delete_path(j, ["b", "x"]).alias("del_x"), jsonx.without_index(F.format_string("[%s,2,3]", key), 1).alias("minus_idx"),
        F.to_json(F.struct(key.alias("a")), {"pretty": "true"}).alias("pretty"),
    )


@query(
    "key_value_maps", "2.13.19 2.13.20 2.13.21",
    """
    SELECT c_custkey, c_mktsegment AS got, NULL::VARCHAR AS missing, true AS has, c_nationkey > 12 AS defined, 'name=' || c_name AS sliced,
           'bal=5,name=' || c_name || ',seg=' || c_mktsegment AS merged, 'name=' || c_name || ',nat=' || CASE WHEN c_nationkey > 12 THEN c_nationkey::VARCHAR ELSE 'null' END AS deleted,
           c_mktsegment = 'BUILDING' AS contains, 'name,nat,seg' AS akeys, true AS any_key, false AS all_keys,
           '{"name":"' || c_name || '","seg":"' || c_mktsegment || '"}' AS js FROM customer
    """,
)
def key_value_maps(t):
    nat = F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string"))
    h = F.create_map(F.lit("name"), F.col("c_name"), F.lit("nat"), nat, F.lit("seg"), F.col("c_mktsegment"))
    show = maps.text
    no_nat = F.map_filter(h, lambda k, v: k != "nat")
    return t.customer.select(
        "c_custkey", maps.get(h, "seg").alias("got"), maps.get(h, "zip").alias("missing"), maps.exist(h, "nat").alias("has"), maps.defined(h, "nat").alias("defined"),
        show(maps.slice(h, ["name", "zip"])).alias("sliced"), show(maps.concat(no_nat, F.create_map(F.lit("bal"), F.lit("5")))).alias("merged"),
        show(maps.delete(h, ["seg"])).alias("deleted"), maps.contains(h, F.create_map(F.lit("seg"), F.lit("BUILDING"))).alias("contains"),
        F.array_join(F.array_sort(F.map_keys(h)), ",").alias("akeys"), maps.exist_any(h, ["zip", "seg"]).alias("any_key"),
        maps.exist_all(h, ["zip", "seg"]).alias("all_keys"), F.to_json(no_nat).alias("js"),
    )


@query(
    "key_value_rows", "2.13.21",
    "SELECT k, v, count(*) AS n FROM (SELECT unnest(['brand', 'type']) AS k, unnest([p_brand, p_type]) AS v FROM part) GROUP BY ALL",
)
def key_value_rows(t):
    h = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return t.part.select(F.explode(h).alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))


@query(
    "composite_rows", "2.13.22 2.24.8",
    """
    SELECT p_partkey, p_size AS dim, p_brand AS brand, (p_size, p_brand) = (11, 'Brand#2') AS same, (p_size, p_brand) > (25, 'Brand#2') AS gt FROM part
    """,
)
def composite_rows(t):
    r = F.struct(F.col("p_size").alias("dim"), F.col("p_brand").alias("brand"))
    that = lambda n: F.struct(F.lit(n).alias("dim"), F.lit("Brand#2").alias("brand"))
    return t.part.select("p_partkey", r.alias("r")).select(
        "p_partkey", "r.dim", "r.brand", (F.col("r") == that(11)).alias("same"), (F.col("r") > that(25)).alias("gt")
    )
