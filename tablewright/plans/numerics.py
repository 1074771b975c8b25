"""Numeric, bit-string and money functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import numerics as num
from tablewright.plans.registry import query


@query(
    "integer_arithmetic", "2.11.1 2.11.2 2.11.7",
    """
    SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * o_custkey AS m,
           CAST(trunc((o_orderkey - 700) / 7) AS BIGINT) AS d, (o_orderkey - 700) % 7 AS r, abs(o_orderkey - o_custkey) AS ab,
           o_orderkey & o_custkey AS b_and, o_orderkey | o_custkey AS b_or, xor(o_orderkey, o_custkey) AS b_xor, ~o_orderkey AS b_not,
           o_custkey << 3 AS l, o_orderkey >> 2 AS rs FROM orders
    """,
)
def integer_arithmetic(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(
        "o_orderkey", (k + c).alias("a"), (k - c).alias("s"), (k * c).alias("m"), num.int_div(k - 700, F.lit(7)).alias("d"),
        ((k - 700) % 7).alias("r"), F.abs(k - c).alias("ab"), k.bitwiseAND(c).alias("b_and"), k.bitwiseOR(c).alias("b_or"),
        k.bitwiseXOR(c).alias("b_xor"), F.bitwise_not(k).alias("b_not"), F.shiftleft(c, 3).alias("l"), F.shiftright(k, 2).alias("rs"),
    )


@query(
    "rounding_and_powers", "2.11.3 2.11.4",
    """
    SELECT c_custkey, ceil(x) AS ce, floor(x) AS fl, trunc(x) AS tr, sign(x)::INTEGER AS sg, round_even(x, 0) AS re, round(sqrt(abs(x)), 9) AS sq,
           round(cbrt(x), 9) AS cb, round(pow(x / 100, 2), 6) AS pw, round(exp(x / 1000), 6) AS ex, round(ln(abs(x) + 1), 9) AS l, round(log10(abs(x) + 1), 9) AS lg
    FROM (SELECT c_custkey, c_acctbal AS x FROM customer)
    """,
)
def rounding_and_powers(t):
    x = F.col("c_acctbal")
    whole = lambda c: c.cast("double")
    return t.customer.select(
        "c_custkey", whole(F.ceil(x)).alias("ce"), whole(F.floor(x)).alias("fl"), whole(num.trunc(x)).alias("tr"), F.signum(x).cast("int").alias("sg"),
        num.round_half_even(x).alias("re"), F.round(F.sqrt(F.abs(x)), 9).alias("sq"), F.round(F.cbrt(x), 9).alias("cb"),
        F.round(F.pow(x / 100, 2), 6).alias("pw"), F.round(F.exp(x / 1000), 6).alias("ex"), F.round(F.ln(F.abs(x) + 1), 9).alias("l"),
        F.round(F.log10(F.abs(x) + 1), 9).alias("lg"),
    )


@query(
    "trigonometry", "2.11.5 2.11.6",
    """
    SELECT p_partkey, round(sin(radians(d)), 9) + 0.0 AS s, round(cos(radians(d)), 9) + 0.0 AS c, round(degrees(asin(u)), 8) AS a_s, round(degrees(acos(u)), 8) AS a_c,
           round(degrees(atan(d)), 8) AS a_t, round(degrees(atan2(d, 10)), 8) AS a_t2, CASE WHEN d % 360 IN (90, 270) THEN 'infinite' ELSE (round(tan(radians(d)), 6) + 0.0 > 0)::VARCHAR END AS tpos,
           round(pi() * d, 8) AS pid, round(1 / tan(radians(d + 0.25)), 6) AS ct
    FROM (SELECT p_partkey, (p_size - 1) * 15.0::DOUBLE AS d, (p_size - 25) / 25 AS u FROM part)
    """,
)
def trigonometry(t):
    d, u = F.col("d"), F.col("u")
    src = t.part.select("p_partkey", ((F.col("p_size") - 1) * F.lit(15.0)).alias("d"), ((F.col("p_size") - 25) / 25).alias("u"))
    zero = lambda c: F.round(c, 9) + 0.0
    tan = num.tand(d)
    return src.select(
        "p_partkey", zero(num.sind(d)).alias("s"), zero(num.cosd(d)).alias("c"), F.round(num.asind(u), 8).alias("a_s"), F.round(num.acosd(u), 8).alias("a_c"),
        F.round(num.atand(d), 8).alias("a_t"), F.round(num.atan2d(d, F.lit(10.0)), 8).alias("a_t2"),
        F.when((d % 360).isin(90, 270), F.lit("infinite")).otherwise((F.round(tan, 6) > 0).cast("string")).alias("tpos"),
        F.round(F.pi() * d, 8).alias("pid"), F.round(num.cotd(d + 0.25), 6).alias("ct"),
    )


@query("random_columns", "2.11.8")
def random_columns(t):
    r = t.orders.select(F.rand(7).alias("r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1)).alias("in_range"), F.round(F.avg("r"), 1).alias("mean"))


@query(
    "factorial_decimal", "2.11.9 2.11.10",
    """
    SELECT p_partkey, factorial((p_size % 16)::INTEGER)::BIGINT AS fact,
           round(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(1.07 AS DECIMAL(4,2)), 2)::DOUBLE AS taxed,
           (CAST(p_retailprice AS DECIMAL(18,2)) * p_size + CAST(0.125 AS DECIMAL(6,3)))::DOUBLE AS total FROM part
    """,
)
def factorial_decimal(t):
    price = F.col("p_retailprice").cast("decimal(12,2)")
    return t.part.select(
        "p_partkey", F.factorial((F.col("p_size") % 16)).alias("fact"), F.round(price * F.lit("1.07").cast("decimal(4,2)"), 2).cast("double").alias("taxed"),
        (price * F.col("p_size") + F.lit("0.125").cast("decimal(6,3)")).cast("double").alias("total"),
    )


@query(
    "width_buckets", "2.11.11",
    """
    SELECT CAST(CASE WHEN x < 0 THEN 0 WHEN x >= 500000 THEN 11 ELSE floor(x / 50000) + 1 END AS BIGINT) AS even_bucket,
           ((x >= 20000)::INTEGER + (x >= 100000)::INTEGER + (x >= 250000)::INTEGER + (x >= 450000)::INTEGER) AS list_bucket, count(*) AS n
    FROM (SELECT o_totalprice AS x FROM orders) GROUP BY ALL
    """,
)
def width_buckets(t):
    x = F.col("o_totalprice")
    edges = F.array(*[F.lit(v) for v in (20000.0, 100000.0, 250000.0, 450000.0)])
    return t.orders.groupBy(
        F.width_bucket(x, F.lit(0.0), F.lit(500000.0), F.lit(10)).alias("even_bucket"), num.width_bucket_array(x, edges).alias("list_bucket")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bit_strings", "2.11.12",
    """
    SELECT o_orderkey, (a & b)::VARCHAR AS b_and, (a | b)::VARCHAR AS b_or, xor(a, b)::VARCHAR AS b_xor, (~a)::VARCHAR AS b_not,
           (a << 3)::VARCHAR AS l, (a >> 2)::VARCHAR AS r, (a::VARCHAR || b::VARCHAR) AS cat, substr(a::VARCHAR, 3, 5) AS sub,
           strpos(a::VARCHAR, '101')::INTEGER AS pos, get_bit(a, 5)::INTEGER AS bit5, set_bit(a, 2, 1)::VARCHAR AS set2, o_orderkey % 65536 AS num
    FROM (SELECT o_orderkey, right((o_orderkey % 65536)::INTEGER::BITSTRING::VARCHAR, 16)::BITSTRING AS a,
                 right((o_custkey % 65536)::INTEGER::BITSTRING::VARCHAR, 16)::BITSTRING AS b FROM orders)
    """,
)
def bit_strings(t):
    s = t.orders.select("o_orderkey", num.bits_from_int(F.col("o_orderkey") % 65536, 16).alias("a"), num.bits_from_int(F.col("o_custkey") % 65536, 16).alias("b"))
    a, b = F.col("a"), F.col("b")
    return s.select(
        "o_orderkey", num.bits_zip(a, b, "and").alias("b_and"), num.bits_zip(a, b, "or").alias("b_or"), num.bits_zip(a, b, "xor").alias("b_xor"),
        num.bits_not(a).alias("b_not"), num.bits_shift(a, 3).alias("l"), num.bits_shift(a, -2).alias("r"), F.concat(a, b).alias("cat"),
        F.substring(a, 3, 5).alias("sub"), F.instr(a, "101").alias("pos"), num.get_bit(a, 5).alias("bit5"), num.set_bit(a, 2, 1).alias("set2"),
        num.bits_to_int(a).alias("num"),
    )


@query(
    "money_columns", "2.11.13",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(c_acctbal)) AS shown,
           trunc(round(c_acctbal * 100) / 4) / 100 AS quarter, round_even(round(c_acctbal * 100) / 8.0, 0) / 100 AS eighth, (CAST(c_acctbal AS DECIMAL(19,2)) + 5)::DOUBLE AS plus5 FROM customer
    """,
)
def money_columns(t):
    m = num.money(F.col("c_acctbal"))
    return t.customer.select(
        "c_custkey", num.money_text(m).alias("shown"), num.money_over_int(m, F.lit(4)).cast("double").alias("quarter"),
        num.money_over(m, F.lit(8.0)).cast("double").alias("eighth"), num.money(m + 5).cast("double").alias("plus5")
    )


@query("money_words", "2.11.13")
def money_words(t):
    return t.spread("orders", "o_orderkey").select("o_orderkey", "o_totalprice", num.cash_words(F.col("o_totalprice").cast("decimal(19,2)")).alias("words"))
