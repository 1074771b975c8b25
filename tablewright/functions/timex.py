"""Date, time and interval functions.

Mixed intervals are ``struct<months int, days int, micros bigint>``; times of day
are microseconds since midnight. Both stand in for types Spark does not have.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000

# Sentinels for the infinite dates.
DATE_INFINITY = "9999-12-31"
DATE_MINUS_INFINITY = "0001-01-01"


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 UTC (session zone UTC for zoneless input)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch(ts: Column) -> Column:
    """Seconds since 1970-01-01, with fraction."""
    return micros(ts) / 1_000_000


def interval(months=0, days=0, micros=0) -> Column:
    as_col = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    return F.struct(as_col(months, "int").alias("months"), as_col(days, "int").alias("days"), as_col(micros, "long").alias("micros"))


def add_interval(ts: Column, iv: Column) -> Column:
    """Months first (clamped to month end), then days, then time."""
    wide = F.make_interval(F.lit(0), iv["months"], F.lit(0), iv["days"], F.lit(0), F.lit(0), iv["micros"].cast("decimal(18,0)") / 1_000_000)
    return ts + wide


def scale_interval(iv: Column, factor: float) -> Column:
    """Multiply; fractions of months spill to days, fractions of days to time."""
    months = iv["months"] * factor
    whole_months = _truncate(months)
    days = iv["days"] * factor + (months - whole_months) * 30
    whole_days = _truncate(days)
    rest = F.round(iv["micros"] * factor + (days - whole_days) * DAY_MICROS)
    return interval(whole_months, whole_days, rest)


def negate_interval(iv: Column) -> Column:
    return interval(-iv["months"], -iv["days"], -iv["micros"])


def sum_intervals(a: Column, b: Column) -> Column:
    return interval(a["months"] + b["months"], a["days"] + b["days"], a["micros"] + b["micros"])


def interval_rank(iv: Column) -> Column:
    """Length used for comparison: a month counts 30 days, a day 24 hours."""
    return (iv["months"].cast("decimal(30,0)") * 30 + iv["days"]) * DAY_MICROS + iv["micros"]


def _truncate(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def justify_hours(iv: Column) -> Column:
    """Whole 24-hour spans become days; the time takes the sign of the days."""
    carried = _truncate(iv["micros"] / DAY_MICROS)
    days, rest = iv["days"] + carried, iv["micros"] - carried * DAY_MICROS
    fix = F.when((days > 0) & (rest < 0), -1).when((days < 0) & (rest > 0), 1).otherwise(0)
    return interval(iv["months"], days + fix, rest - fix * DAY_MICROS)


def justify_days(iv: Column) -> Column:
    """Whole 30-day spans become months; the days take the sign of the months."""
    carried = _truncate(iv["days"] / 30)
    months, rest = iv["months"] + carried, iv["days"] - carried * 30
    fix = F.when((months > 0) & (rest < 0), -1).when((months < 0) & (rest > 0), 1).otherwise(0)
    return interval(months + fix, rest - fix * 30, iv["micros"])


def justify_interval(iv: Column) -> Column:
    """Both steps with one sign for all fields."""
    total = (iv["months"].cast("long") * 30 + iv["days"]) * F.lit(DAY_MICROS) + iv["micros"]
    sign = F.signum(total.cast("double")).cast("long")
    size = F.abs(total)
    whole_days = F.floor(size / DAY_MICROS)
    return interval(
        sign * F.floor(whole_days / 30), sign * (whole_days % 30), sign * (size - whole_days * DAY_MICROS)
    )


def age(later: Column, earlier: Column) -> Column:
    """Calendar difference as years and months, days, and time; all of one sign."""
    swap = later < earlier
    hi, lo = F.greatest(later, earlier), F.least(later, earlier)
    tod = lambda c: micros(c) - micros(F.date_trunc("day", c.cast("timestamp")))
    clock = tod(hi) - tod(lo)
    borrow_day = (clock < 0).cast("int")
    days = F.dayofmonth(hi) - F.dayofmonth(lo) - borrow_day
    borrow_month = (days < 0).cast("int")
    months = (F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo) - borrow_month
    # a borrowed month has the length of the month of the earlier date
    length = F.dayofmonth(F.last_day(lo))
    sign = F.when(swap, -1).otherwise(1)
    return interval(sign * months, sign * (days + borrow_month * length), sign * (clock + borrow_day * F.lit(DAY_MICROS)))


def date_trunc(field: str, ts: Column) -> Column:
    """Truncation that also knows decade, century and millennium."""
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if field not in spans:
        return F.date_trunc(field, ts)
    n, year = spans[field], F.year(ts)
    first = F.floor(year / 10) * 10 if field == "decade" else F.floor((year - 1) / n) * n + 1
    return F.make_date(first.cast("int"), F.lit(1), F.lit(1)).cast("timestamp")


def trunc_interval(field: str, iv: Column) -> Column:
    """Drop the parts of an interval below ``field``."""
    month_units = {"millennium": 12000, "century": 1200, "decade": 120, "year": 12, "quarter": 3, "month": 1}
    if field in month_units:
        n = month_units[field]
        return interval(_truncate(iv["months"] / n) * n)
    if field == "day":
        return interval(iv["months"], iv["days"])
    unit = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "milliseconds": 1000}[field]
    return interval(iv["months"], iv["days"], _truncate(iv["micros"] / unit) * unit)


def date_part(field: str, ts: Column) -> Column:
    """Field of a timestamp as a number; Sunday is day 0 of the week."""
    year = F.year(ts)
    second = F.extract(F.lit("SECOND"), ts)
    parts = {
        "dow": lambda: F.dayofweek(ts) - 1,
        "isodow": lambda: F.weekday(ts) + 1,
        "doy": lambda: F.dayofyear(ts),
        "epoch": lambda: epoch(ts),
        "isoyear": lambda: F.extract(F.lit("YEAROFWEEK"), ts),
        "week": lambda: F.weekofyear(ts),
        "decade": lambda: F.floor(year / 10),
        "century": lambda: F.floor((year + 99) / 100),
        "millennium": lambda: F.floor((year + 999) / 1000),
        "milliseconds": lambda: second * 1000,
        "microseconds": lambda: second * 1_000_000,
        "julian": lambda: F.datediff(ts, F.lit("1970-01-01").cast("date")) + 2440588 + (epoch(ts) % 86400) / 86400,
    }
    if field in parts:
        return parts[field]()
    return F.extract(F.lit(field.upper()), ts)


# Fields of a format template and their date_format patterns.
TEMPLATE_FIELDS = {
    "YYYY": "yyyy", "YY": "yy", "MONTH": "MMMM", "MON": "MMM", "MM": "MM", "DDD": "DDD", "DD": "dd", "DAY": "EEEE", "DY": "EEE",
    "HH24": "HH", "HH12": "hh", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS", "AM": "a", "PM": "a", "Q": "q",
}
_NAMES = ("MONTH", "MON", "DAY", "DY")


def split_template(template: str) -> list[tuple[str, str]]:
    """Template pieces as (kind, text): field, name or literal."""
    out, i = [], 0
    fields = sorted(TEMPLATE_FIELDS, key=len, reverse=True)
    while i < len(template):
        if template[i] == '"':
            j = template.index('"', i + 1)
            out.append(("literal", template[i + 1 : j]))
            i = j + 1
            continue
        if template[i : i + 2].upper() == "FM":
            out.append(("trim", ""))
            i += 2
            continue
        hit = next((f for f in fields if template[i : i + len(f)].upper() == f), None)
        if hit:
            out.append(("name" if hit in _NAMES else "field", template[i : i + len(hit)]))
            i += len(hit)
        else:
            out.append(("literal", template[i]))
            i += 1
    return out


def to_char(ts: Column, template: str) -> Column:
    """Format by template: names follow the case of their pattern and full names are
    blank-padded to nine characters unless ``FM`` stands before them."""
    pieces, trim = [], False
    for kind, text in split_template(template):
        if kind == "trim":
            trim = True
        elif kind == "literal":
            pieces.append(F.lit(text))
        else:
            value = F.date_format(ts, TEMPLATE_FIELDS[text.upper()])
            if kind == "name":
                if text.isupper():
                    value = F.upper(value)
                elif text.islower():
                    value = F.lower(value)
                if text.upper() in ("MONTH", "DAY") and not trim:
                    value = F.rpad(value, 9, " ")
            elif trim:
                value = F.regexp_replace(value, "^0+(?=.)", "")
            pieces.append(value)
            trim = False
    return F.concat(*pieces)


def to_timestamp(text: Column, template: str) -> Column:
    """Parse by template."""
    pattern = ""
    for kind, piece in split_template(template):
        if kind == "literal":
            pattern += f"'{piece}'" if piece.isalpha() else piece
        elif kind != "trim":
            pattern += TEMPLATE_FIELDS[piece.upper()]
    return F.to_timestamp_ntz(text, F.lit(pattern))


def to_date(text: Column, template: str) -> Column:
    return to_timestamp(text, template).cast("date")


def overlaps(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Do periods (a, b) and (c, d) overlap? Ends may come in any order and are open;
    a period of one instant holds that instant."""
    s1, e1, s2, e2 = F.least(a, b), F.greatest(a, b), F.least(c, d), F.greatest(c, d)
    return (s1 == s2) | ((s1 < s2) & (s2 < e1)) | ((s2 < s1) & (s1 < e2))


def is_finite(d: Column) -> Column:
    return ~d.cast("date").isin(F.lit(DATE_INFINITY).cast("date"), F.lit(DATE_MINUS_INFINITY).cast("date"))


def time_of_day(ts: Column) -> Column:
    """Microseconds since midnight."""
    return F.pmod(micros(ts), F.lit(DAY_MICROS))


def time_add(time: Column, iv: Column) -> Column:
    """Time plus the clock part of an interval, around midnight."""
    return F.pmod(time + iv["micros"], F.lit(DAY_MICROS))


def time_text(time: Column) -> Column:
    """``HH:MM:SS`` with microseconds when there are any."""
    base = F.format_string(
        "%02d:%02d:%02d", F.floor(time / 3_600_000_000), F.floor(time / 60_000_000) % 60, F.floor(time / 1_000_000) % 60
    )
    fraction = time % 1_000_000
    return F.when(fraction == 0, base).otherwise(F.concat(base, F.lit("."), F.rtrim(F.format_string("%06d", fraction), F.lit("0"))))


def timetz_rank(time: Column, zone_seconds: Column) -> Column:
    """Order of times with zone: by instant, then by zone, west last."""
    return F.struct((time - zone_seconds.cast("long") * 1_000_000).alias("utc"), (-zone_seconds).alias("zone"))


def time_at_zone(time: Column, zone_seconds: Column, new_zone_seconds: Column) -> Column:
    return F.pmod(time + (new_zone_seconds - zone_seconds).cast("long") * 1_000_000, F.lit(DAY_MICROS))
