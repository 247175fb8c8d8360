"""Dates, times, timestamps without zone, and intervals.

An interval is struct<months int, days int, micros bigint>, as Spark's own kinds cannot mix. In arithmetic a month is 30
days. A time is the microseconds of its day.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, value

MONTH_DAYS, DAY_MICROS = 30, 86_400_000_000
# Strftime directives and the letters that Spark's formatter has for them.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%e": "d", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%%": "%"}
# Microseconds of a unit; months of the larger ones.
MICROS = {"HOUR": 3_600_000_000, "MINUTE": 60_000_000, "SECOND": 1_000_000}
MONTHS = {"YEAR": 12, "MONTH": 1}


def interval(months: int | Column = 0, days: int | Column = 0, micros: int | Column = 0) -> Column:
    return F.struct(value(months).cast("int").alias("months"), value(days).cast("int").alias("days"), value(micros).cast("bigint").alias("micros"))


def parse_interval(text: str, unit: str) -> tuple[int, int, int]:
    """Months, days and microseconds of a literal such as '2' DAY, '1-3' YEAR TO MONTH or '1 02:30:00' DAY TO SECOND."""
    unit = " ".join(unit.upper().split())
    sign = -1 if text.strip().startswith("-") else 1
    body = text.strip().lstrip("+-").strip()
    if unit in MONTHS:
        return sign * int(body) * MONTHS[unit], 0, 0
    if unit == "DAY":
        return 0, sign * int(body), 0
    if unit in MICROS:
        return 0, 0, sign * round(float(body) * MICROS[unit])
    if unit == "YEAR TO MONTH":
        years, months = body.split("-")
        return sign * (int(years) * 12 + int(months)), 0, 0
    first, _, last = unit.partition(" TO ")
    days, clock = (body.split(" ", 1) if " " in body else (body, "0")) if first == "DAY" else ("0", body)
    names = ["HOUR", "MINUTE", "SECOND"]
    names = names[names.index("HOUR" if first == "DAY" else first) : names.index(last) + 1]
    micros = sum(round(float(x) * MICROS[n]) for x, n in zip(clock.split(":"), names))
    return 0, sign * int(days), sign * micros


def interval_literal(text: str, unit: str) -> Column:
    return interval(*parse_interval(text, unit))


def _days(i: Column) -> Column:
    return i["days"] + i["months"] * MONTH_DAYS


def add_to_date(d, i) -> Column:
    """A date and a number of days, or an interval; what is under a day does not count."""
    return F.date_add(column(d), value(i) if isinstance(i, int) else _days(i))


def subtract_from_date(d, i) -> Column:
    return F.date_sub(column(d), value(i) if isinstance(i, int) else _days(i))


def _moved(ts: Column, micros: Column) -> Column:
    whole = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)"))
    return ts + whole.cast("interval day to second")


def add_to_timestamp(ts, i: Column) -> Column:
    return _moved(column(ts), i["micros"] + _days(i).cast("bigint") * DAY_MICROS)


def subtract_from_timestamp(ts, i: Column) -> Column:
    return _moved(column(ts), -(i["micros"] + _days(i).cast("bigint") * DAY_MICROS))


def add_to_time(t, i: Column) -> Column:
    """Around midnight."""
    return F.pmod(column(t) + i["micros"], F.lit(DAY_MICROS))


def date_difference(a, b) -> Column:
    return interval(days=F.datediff(column(a), column(b)))


def micros_of(ts) -> Column:
    """Microseconds since 1970, of a timestamp without zone."""
    return F.unix_micros(column(ts).cast("timestamp_ltz"))


def timestamp_difference(a, b) -> Column:
    return interval(micros=micros_of(a) - micros_of(b))


def interval_add(a: Column, b: Column) -> Column:
    return interval(*(a[f] + b[f] for f in ("months", "days", "micros")))


def interval_subtract(a: Column, b: Column) -> Column:
    return interval(*(a[f] - b[f] for f in ("months", "days", "micros")))


def interval_multiply(a: Column, n) -> Column:
    return interval(*(a[f] * value(n) for f in ("months", "days", "micros")))


def interval_divide(a: Column, n) -> Column:
    """Each part by itself, toward zero."""
    n = value(n)
    return interval(*((a[f] - a[f] % n) / n for f in ("months", "days", "micros")))


def extract(part: str, x) -> Column:
    """A BIGINT; seconds are whole."""
    return {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}[part.upper()](column(x)).cast("bigint")


def extract_from_interval(part: str, i: Column) -> Column:
    whole = lambda x, n: ((x - x % n) / n).cast("bigint")
    of = {
        "YEAR": lambda: whole(i["months"], 12),
        "MONTH": lambda: i["months"] % 12,
        "DAY": lambda: i["days"],
        "HOUR": lambda: whole(i["micros"], MICROS["HOUR"]),
        "MINUTE": lambda: whole(i["micros"] % MICROS["HOUR"], MICROS["MINUTE"]),
        "SECOND": lambda: whole(i["micros"] % MICROS["MINUTE"], MICROS["SECOND"]),
    }
    return of[part.upper()]().cast("bigint")


def spark_pattern(directives: str) -> str:
    """A strftime pattern in the letters of Spark's formatter; letters outside directives are quoted."""
    parts = re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", directives)
    return reduce(lambda out, p: out + (DIRECTIVES[p] if p in DIRECTIVES else f"'{p}'" if p.isalpha() else p), parts, "")


def to_date(s, directives: str) -> Column:
    return F.to_date(column(s), spark_pattern(directives))


def to_timestamp(s, directives: str) -> Column:
    return F.to_timestamp_ntz(column(s), F.lit(spark_pattern(directives)))


def to_time(s, directives: str) -> Column:
    """Microseconds of the day."""
    return F.pmod(micros_of(F.to_timestamp_ntz(F.concat(F.lit("1970-01-01 "), column(s)), F.lit("yyyy-MM-dd " + spark_pattern(directives)))), F.lit(DAY_MICROS))


def generate_uuid(transaction: str, row_key) -> Column:
    """Deterministic: of the transaction's name and the row's key."""
    h = F.md5(F.concat_ws("/", F.lit(transaction), column(row_key).cast("string")))
    ends = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ends))
