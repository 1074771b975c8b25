"""Date, time and interval functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import timex
from tablewright.plans.registry import query

stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query(
    "date_arithmetic", "2.10.1 2.10.2 2.10.3 2.10.12",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
           strftime(CAST(l_shipdate AS DATE) + 45, '%Y-%m-%d') AS plus45, CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS since,
           strftime(l_shipdate + INTERVAL 1 MONTH + INTERVAL 2 DAY, '%Y-%m-%d') AS later,
           date_diff('day', o_orderdate, l_shipdate) AS waited, l_shipdate - o_orderdate > INTERVAL 2 MONTH AS slow
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def date_arithmetic(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    ship = F.col("l_shipdate")
    waited = timex.micros(ship) - timex.micros(F.col("o_orderdate"))
    iv = lambda **k: timex.interval(**k)
    return joined.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", F.date_format(F.date_add(ship, 45), "yyyy-MM-dd").alias("plus45"),
        F.datediff(ship, F.lit("1995-01-01").cast("date")).cast("long").alias("since"),
        F.date_format(timex.add_interval(ship, iv(months=1, days=2)), "yyyy-MM-dd").alias("later"),
        F.datediff(ship, F.col("o_orderdate")).cast("long").alias("waited"),
        (timex.interval_rank(iv(micros=waited)) > timex.interval_rank(iv(months=2))).alias("slow"),
    )


@query(
    "age_of_orders", "2.10.4",
    """
    SELECT o_orderkey, year(a)::INTEGER * 12 + month(a)::INTEGER AS months, day(a)::INTEGER AS days,
           (hour(a) * 3600 + minute(a) * 60 + second(a))::INTEGER AS seconds
    FROM (SELECT o_orderkey, age(TIMESTAMP '1999-03-30 10:30:00', o_orderdate) AS a FROM orders)
    """,
)
def age_of_orders(t):
    a = timex.age(F.lit("1999-03-30 10:30:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    return t.orders.select("o_orderkey", a.alias("a")).select(
        "o_orderkey", F.col("a.months").alias("months"), F.col("a.days").alias("days"), (F.col("a.micros") / 1_000_000).cast("int").alias("seconds")
    )


TRUNCS = ["second", "minute", "hour", "day", "week", "month", "quarter", "year", "decade", "century", "millennium"]


@query(
    "date_truncation", "2.10.5",
    "SELECT event_id, " + ", ".join(f"strftime(date_trunc('{f}', ts::TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS t_{f}" for f in TRUNCS[:-2])
    + ", (floor((year(ts) - 1) / 100) * 100 + 1)::INTEGER || '-01-01 00:00:00' AS t_century, (floor((year(ts) - 1) / 1000) * 1000 + 1)::INTEGER || '-01-01 00:00:00' AS t_millennium FROM events",
)
def date_truncation(t):
    return t.events.select("event_id", *[stamp(timex.date_trunc(f, F.col("ts"))).alias(f"t_{f}") for f in TRUNCS])


PARTS = ["year", "quarter", "month", "week", "day", "hour", "minute", "dow", "isodow", "doy", "isoyear", "decade", "century", "millennium"]


@query(
    "date_parts", "2.10.6",
    "SELECT event_id, " + ", ".join(f"date_part('{f}', ts)::BIGINT AS p_{f}" for f in PARTS)
    + ", round(epoch(ts), 6) AS p_epoch, (microsecond(ts))::BIGINT AS p_us FROM events",
)
def date_parts(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", *[timex.date_part(f, ts).cast("long").alias(f"p_{f}") for f in PARTS],
        F.round(timex.date_part("epoch", ts), 6).alias("p_epoch"), timex.date_part("microseconds", ts).cast("long").alias("p_us"),
    )


@query(
    "date_constructors", "2.10.7",
    """
    SELECT o_orderkey, strftime(make_date(year(o_orderdate), month(o_orderdate), 1), '%Y-%m-%d') AS first_day,
           strftime(make_timestamp(year(o_orderdate), 1, 2, (o_orderkey % 24)::BIGINT, 30, 15.0), '%Y-%m-%d %H:%M:%S') AS made,
           strftime(o_orderdate + to_days((o_orderkey % 10)::INTEGER) + to_hours(o_orderkey % 30), '%Y-%m-%d %H:%M:%S') AS moved FROM orders
    """,
)
def date_constructors(t):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    return t.orders.select(
        "o_orderkey", F.date_format(F.make_date(F.year(d), F.month(d), F.lit(1)), "yyyy-MM-dd").alias("first_day"),
        stamp(F.make_timestamp_ntz(F.year(d), F.lit(1), F.lit(2), (k % 24).cast("int"), F.lit(30), F.lit(15))).alias("made"),
        stamp(d + F.make_dt_interval((k % 10).cast("int"), (k % 30).cast("int"))).alias("moved"),
    )


@query(
    "time_zones", "2.10.8",
    """
    SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS tokyo, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS ny_winter,
           strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS from_india FROM events
    """,
)
def time_zones(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", stamp(F.from_utc_timestamp(ts, "Asia/Tokyo")).alias("tokyo"),
        stamp(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))).alias("ny_winter"),
        stamp(F.to_utc_timestamp(ts, "Asia/Kolkata")).alias("from_india"),
    )


@query(
    "template_formats", "2.10.9",
    """
    SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, upper(strftime(ts, '%b')) || '-' || strftime(ts, '%d-%y') AS b,
           strftime(ts, 'day %j of %Y, %A') AS c, rpad(strftime(ts, '%B'), 9, ' ') || '|' || strftime(ts, '%I:%M %p') AS d,
           printf('%010.2f', value) AS n
    FROM events
    """,
)
def template_formats(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", timex.to_char(ts, "YYYY/MM/DD HH24:MI:SS").alias("a"), timex.to_char(ts, "MON-DD-YY").alias("b"),
        timex.to_char(ts, '"day "DDD" of "YYYY, FMDay').alias("c"), timex.to_char(ts, "Month|HH12:MI AM").alias("d"),
        F.to_char(F.col("value").cast("decimal(12,2)"), F.lit("0000000.00")).alias("n"),
    )


@query(
    "template_parsing", "2.10.10",
    """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS stamp, strftime(ts, '%Y-%m-%d') AS day,
           round(value, 2) AS num, strftime(to_timestamp(event_id * 1000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS from_epoch FROM events
    """,
)
def template_parsing(t):
    ts = F.col("ts")
    text = timex.to_char(ts, "DD Mon YYYY HH24:MI:SS")
    return t.events.select(
        "event_id", stamp(timex.to_timestamp(text, "DD Mon YYYY HH24:MI:SS")).alias("stamp"),
        F.date_format(timex.to_date(timex.to_char(ts, "YYYYMMDD"), "YYYYMMDD"), "yyyy-MM-dd").alias("day"),
        F.to_number(F.format_number("value", 2), F.lit("999,999.99")).cast("double").alias("num"),
        stamp(F.timestamp_seconds(F.col("event_id") * 1000)).alias("from_epoch"),
    )


@query(
    "interval_justification", "2.10.11 2.10.12",
    """
    WITH i AS (SELECT o_orderkey, (o_orderkey % 7)::BIGINT AS mo, (o_custkey % 100)::BIGINT AS da, (o_orderkey % 200) * 3600000000 AS us FROM orders),
    h AS (SELECT *, da + us // 86400000000 AS hd, us % 86400000000 AS hu, da // 30 AS dm, da % 30 AS dd FROM i)
    SELECT o_orderkey, mo::INTEGER || ' ' || hd || ' ' || hu::BIGINT AS hours, (mo + dm) || ' ' || dd || ' ' || us::BIGINT AS days,
           (mo + hd // 30) || ' ' || (hd % 30) || ' ' || hu::BIGINT AS both_ways,
           (2 * mo) || ' ' || (2 * da) || ' ' || (2 * us)::BIGINT AS twice, (-mo) || ' ' || (-da) || ' ' || (-us)::BIGINT AS negated
    FROM h
    """,
)
def interval_justification(t):
    iv = timex.interval((F.col("o_orderkey") % 7), (F.col("o_custkey") % 100), (F.col("o_orderkey") % 200) * 3_600_000_000)
    show = lambda i: F.concat_ws(" ", i["months"].cast("string"), i["days"].cast("string"), i["micros"].cast("string"))
    o = t.orders.select("o_orderkey", iv.alias("iv"))
    x = F.col("iv")
    return o.select(
        "o_orderkey", show(timex.justify_hours(x)).alias("hours"), show(timex.justify_days(x)).alias("days"),
        show(timex.justify_interval(x)).alias("both_ways"), show(timex.scale_interval(x, 2.0)).alias("twice"),
        show(timex.negate_interval(x)).alias("negated"),
    )


@query(
    "overlapping_periods", "2.10.13",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, (s1 = s2 OR (s1 < s2 AND s2 < e1) OR (s2 < s1 AND s1 < e2)) AS hit FROM (
      SELECT *, least(o_orderdate, l_shipdate) AS s1, greatest(o_orderdate, l_shipdate) AS e1,
             TIMESTAMP '1998-01-01' AS s2, TIMESTAMP '1998-02-01' AS e2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    """,
)
def overlapping_periods(t):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    hit = timex.overlaps(F.col("o_orderdate"), F.col("l_shipdate"), ts("1998-02-01"), ts("1998-01-01"))
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", hit.alias("hit"))


@query(
    "infinite_dates", "2.10.14",
    """
    SELECT finite, count(*) AS n FROM (SELECT NOT (o_orderstatus = 'O') AS finite FROM orders) GROUP BY 1
    """,
)
def infinite_dates(t):
    closed = F.when(F.col("o_orderstatus") == "O", F.lit(timex.DATE_INFINITY).cast("date")).otherwise(F.col("o_orderdate").cast("date"))
    return t.orders.groupBy(timex.is_finite(closed).alias("finite")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "time_of_day", "2.10.15",
    """
    SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(date_trunc('second', ts) + INTERVAL 90 MINUTE, '%H:%M:%S') AS later,
           strftime(date_trunc('second', ts) - INTERVAL 8 HOUR, '%H:%M:%S') AS west FROM events
    """,
)
def time_of_day(t):
    sec = timex.time_of_day(F.date_trunc("second", "ts"))
    return t.events.select(
        "event_id", timex.time_text(sec).alias("clock"), timex.time_text(timex.time_add(sec, timex.interval(micros=5_400_000_000))).alias("later"),
        timex.time_text(timex.time_at_zone(sec, F.lit(0), F.lit(-8 * 3600))).alias("west"),
    )


@query("current_time", "2.10.16", "SELECT count(*) AS n, true AS stable, true AS past FROM events")
def current_time(t):
    now = F.current_timestamp()
    return t.events.agg(
        F.count(F.lit(1)).alias("n"), (F.min(now) == F.max(now)).alias("stable"), F.bool_and(F.col("ts").cast("timestamp") < now).alias("past")
    )
