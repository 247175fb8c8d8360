"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import datetimes as D
from ..functions import geometry as G
from ..functions import nulls as N
from ..functions import numbers as M
from ..functions import predicates as P
from ..functions import strings as S
from .. import types as T
from .catalogue import query

_STRINGS = {
    "str_upper_lower": ("upper(p_name) AS u, lower(p_type) AS l", lambda: [S.upper("p_name").alias("u"), S.lower("p_type").alias("l")]),
    "str_length": ("CAST(length(p_name) AS BIGINT) AS n, CAST(strlen(p_name) AS BIGINT) AS b", lambda: [S.length("p_name").alias("n"), S.length("p_name", "bytes").alias("b")]),
    "str_concat": ("CASE WHEN p_size = 3 THEN NULL ELSE concat(p_name, NULLIF(p_brand, 'Brand#11'), p_size) END AS c", lambda: [S.concat(F.when(F.col("p_size") != 3, F.col("p_name")), F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.col("p_size")).alias("c")]),
    "str_concat_op": ("p_name || '-' || CAST(NULLIF(p_size, 3) AS VARCHAR) AS c", lambda: [S.concat_op(F.col("p_name"), "-", F.nullif(F.col("p_size"), F.lit(3))).alias("c")]),
    "str_substr": ("substring(p_name, 2, 4) AS a, substring(p_name, 3) AS b, CASE WHEN length(p_name) >= 3 THEN right(p_name, 3) ELSE p_name END AS c, substring(p_name, 1, 2) AS d, substring(p_name, 1000) AS e", lambda: [S.substr("p_name", 2, 4).alias("a"), S.substr("p_name", 3).alias("b"), S.substr("p_name", -3).alias("c"), S.substr("p_name", 0, 2).alias("d"), S.substr("p_name", 1000).alias("e")]),
    "str_trim": ("trim('  ' || p_name || '  ') AS a, ltrim('xyx' || p_name, 'xy') AS b, rtrim(p_name || 'xyx', 'xy') AS c, trim('xx' || p_name || 'y', 'xy') AS d", lambda: [S.trim(F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n"))).alias("a"), S.ltrim(F.concat(F.lit("xyx"), F.col("p_name")), "xy").alias("b"), S.rtrim(F.concat(F.col("p_name"), F.lit("xyx")), "xy").alias("c"), S.trim(F.concat(F.lit("xx"), F.col("p_name"), F.lit("y")), "xy").alias("d")]),
    "str_replace": ("replace(p_name, 'a', 'AA') AS a, p_name AS b", lambda: [S.replace("p_name", "a", "AA").alias("a"), S.replace("p_name", "", "x").alias("b")]),
    "str_reverse": ("reverse(p_name) AS r", lambda: [S.reverse("p_name").alias("r")]),
    "str_contains": ("contains(p_name, 'e') AS e, contains(p_type, p_brand) AS b", lambda: [S.contains("p_name", "e").alias("e"), S.contains("p_type", F.col("p_brand")).alias("b")]),
    "str_find_idx": ("CAST(strpos(p_name, 'e') AS BIGINT) AS e, CAST(0 AS BIGINT) AS none, CAST(CASE WHEN strpos(substring(p_name, 3), 'e') = 0 THEN 0 ELSE strpos(substring(p_name, 3), 'e') + 2 END AS BIGINT) AS later", lambda: [S.find_idx("p_name", "e").alias("e"), S.find_idx("p_name", "").alias("none"), S.find_idx("p_name", "e", 3).alias("later")]),
    "str_is_empty": ("replace(p_brand, 'Brand#1', '') = '' AS e, p_name = '' AS n", lambda: [S.is_empty(S.replace("p_brand", "Brand#1", "")).alias("e"), S.is_empty("p_name").alias("n")]),
}
for _name, (_sql, _make) in _STRINGS.items():
    query(_name, f"SELECT p_partkey, {_sql} FROM part")(lambda t, make=_make: t.part.select("p_partkey", *make()))


@query("str_documents", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n, lower(substring(text, 1, 20)) AS head, CAST(strpos(text, 'e') AS BIGINT) AS e FROM documents")
def str_documents(t):
    return t.documents.select("doc_id", S.length("text").alias("n"), S.lower(S.substr("text", 1, 20)).alias("head"), S.find_idx("text", "e").alias("e"))


_NUMBERS = {
    "math_abs": ("abs(p_size - 25) AS a, abs(-p_retailprice) AS b", lambda c: [F.abs(c("p_size") - 25).alias("a"), F.abs(-c("p_retailprice")).alias("b")]),
    "math_round": ("round(p_retailprice) AS a, round(p_retailprice, 1) AS b, round_even(CAST(p_size AS DECIMAL(10,1)) / 2, 0)::BIGINT AS c", lambda c: [M.round_(c("p_retailprice")).alias("a"), M.round_(c("p_retailprice"), 1).alias("b"), M.round_(c("p_size").cast("decimal(10,1)") / 2, 0, decimal=True).cast("bigint").alias("c")]),
    "math_ceil_floor": ("CAST(ceil(p_retailprice) AS BIGINT) AS a, CAST(floor(-p_retailprice) AS BIGINT) AS b", lambda c: [M.ceil(c("p_retailprice")).alias("a"), M.floor(-c("p_retailprice")).alias("b")]),
    "math_sqrt_power": ("round(sqrt(p_retailprice), 8) AS a, round(power(p_size, 1.5), 6) AS b", lambda c: [F.round(M.sqrt(c("p_retailprice")), 8).alias("a"), F.round(M.power(c("p_size"), 1.5), 6).alias("b")]),
    "math_trig": ("round(sin(p_size), 10) AS a, round(cos(p_size), 10) AS b, round(tan(p_size), 8) AS c, round(asin(p_size / 100.0), 10) AS d, round(acos(p_size / 100.0), 10) AS e, round(atan(p_size), 10) AS f", lambda c: [F.round(F.sin(c("p_size")), 10).alias("a"), F.round(F.cos(c("p_size")), 10).alias("b"), F.round(F.tan(c("p_size")), 8).alias("c"), F.round(F.asin(c("p_size") / 100), 10).alias("d"), F.round(F.acos(c("p_size") / 100), 10).alias("e"), F.round(F.atan(c("p_size")), 10).alias("f")]),
    "math_int_div": ("CAST(p_size // 7 AS BIGINT) AS a, CAST((-p_size) // 7 AS BIGINT) AS b", lambda c: [M.int_div(c("p_size"), 7).alias("a"), M.int_div(-c("p_size"), 7).alias("b")]),
    "math_remainder": ("p_size % 7 AS a, (-p_size) % 7 AS b", lambda c: [M.remainder(c("p_size"), 7).alias("a"), M.remainder(-c("p_size"), 7).alias("b")]),
    "math_exponentiate": ("CAST(p_size AS BIGINT) * p_size * p_size AS a, CAST(1 AS BIGINT) AS b", lambda c: [M.exponentiate(c("p_size"), 3).alias("a"), M.exponentiate(c("p_size"), 0).alias("b")]),
    "math_factorial": ("CAST(factorial((p_size % 21)::INTEGER) AS BIGINT) AS a", lambda c: [M.factorial(c("p_size") % 21).alias("a")]),
    "math_unary": ("-p_size AS a, +p_size AS b", lambda c: [(-c("p_size")).alias("a"), c("p_size").alias("b")]),
    "math_arithmetic": ("p_size + 1 AS a, p_size - 1 AS b, p_size * 2 AS c, round(p_retailprice / 3, 8) AS d", lambda c: [(c("p_size") + 1).alias("a"), (c("p_size") - 1).alias("b"), (c("p_size") * 2).alias("c"), F.round(c("p_retailprice") / 3, 8).alias("d")]),
    "bit_logic": ("p_size & 12 AS a, p_size | 3 AS b, xor(p_size, 5) AS c, ~p_size AS d", lambda c: [M.bit_and(c("p_size"), 12).alias("a"), M.bit_or(c("p_size"), 3).alias("b"), M.bit_xor(c("p_size"), 5).alias("c"), M.bit_not(c("p_size")).alias("d")]),
    "bit_shift": ("CAST(p_size AS BIGINT) << 3 AS a, CAST(p_size AS BIGINT) >> 1 AS b", lambda c: [M.shift_left(c("p_size"), 3).alias("a"), M.shift_right(c("p_size"), 1).alias("b")]),
    "null_coalesce": ("COALESCE(NULLIF(p_size, 3), NULLIF(p_size, 3), -1) AS a, IFNULL(NULLIF(p_brand, 'Brand#11'), 'none') AS b", lambda c: [N.coalesce(F.nullif(c("p_size"), F.lit(3)), F.nullif(c("p_size"), F.lit(3)), -1).alias("a"), N.ifnull(F.nullif(c("p_brand"), F.lit("Brand#11")), "none").alias("b")]),
    "null_nullif": ("NULLIF(p_size, 3) AS a, NULLIF(p_brand, p_type) AS b", lambda c: [N.nullif(c("p_size"), 3).alias("a"), N.nullif(c("p_brand"), c("p_type")).alias("b")]),
    "greatest_least": ("greatest(p_size, 10) AS a, least(p_size, 10, 7) AS b", lambda c: [N.greatest(c("p_size"), 10, kind="int").alias("a"), N.least(c("p_size"), 10, 7, kind="int").alias("b")]),
    "cast_unsigned": ("CAST(p_size AS SMALLINT) AS a, CAST(p_size AS BIGINT) AS b", lambda c: [T.cast(c("p_size"), "TINYINT UNSIGNED").alias("a"), T.cast(c("p_size"), "INT UNSIGNED").alias("b")]),
    "nan_equality": ("FALSE AS a, p_size > 10 AS b", lambda c: [P.equal_number(F.lit(float("nan")), F.lit(float("nan"))).alias("a"), (c("p_size") > 10).alias("b")]),
}
for _name, (_sql, _make) in _NUMBERS.items():
    query(_name, f"SELECT p_partkey, {_sql} FROM part")(lambda t, make=_make: t.part.select("p_partkey", *make(F.col)))


@query("dt_extract", "SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS BIGINT) AS s FROM events")
def dt_extract(t):
    names = {"y": "YEAR", "m": "MONTH", "d": "DAY", "h": "HOUR", "mi": "MINUTE", "s": "SECOND"}
    return t.events.select("event_id", *(D.extract(part, "ts").alias(n) for n, part in names.items()))


@query("dt_plus_interval", """SELECT o_orderkey, o_orderdate + INTERVAL 33 DAY + INTERVAL 5 HOUR AS later, o_orderdate - INTERVAL 30 DAY AS month_before, CAST(o_orderdate AS DATE) + 10 AS d10, CAST(CAST(o_orderdate AS DATE) - INTERVAL 361 DAY AS DATE) AS year_before FROM orders""")
def dt_plus_interval(t):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        D.add_to_timestamp("o_orderdate", D.interval(1, 3, 5 * 3_600_000_000)).alias("later"),
        D.subtract_from_timestamp("o_orderdate", D.interval_literal("1", "MONTH")).alias("month_before"),
        D.add_to_date(day, 10).alias("d10"),
        D.subtract_from_date(day, D.interval(12, 1)).alias("year_before"),
    )


@query("dt_diff", """SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS days, epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1995-01-01') AS micros FROM lineitem""")
def dt_diff(t):
    start = F.lit("1995-01-01")
    return t.lineitem.select("l_orderkey", "l_linenumber", D.date_difference(F.to_date("l_shipdate"), start.cast("date"))["days"].cast("bigint").alias("days"), D.timestamp_difference("l_shipdate", start.cast("timestamp_ntz"))["micros"].alias("micros"))


@query("dt_parse", """SELECT event_id, CAST(strptime(strftime(ts, '%d/%m/%Y'), '%d/%m/%Y') AS DATE) AS d, date_trunc('second', ts) AS t FROM events""")
def dt_parse(t):
    return t.events.select("event_id", D.to_date(F.date_format("ts", "dd/MM/yyyy"), "%d/%m/%Y").alias("d"), D.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "%Y-%m-%d %H:%M:%S").alias("t"))


@query("dt_interval_arithmetic", """SELECT event_id, (user_id % 20) * 3 + 12 AS months, (user_id % 7) * 3 // 2 AS days, (user_id % 20) * 3 // 12 AS years FROM events""")
def dt_interval_arithmetic(t):
    i = D.interval(F.col("user_id") % 20, F.col("user_id") % 7)
    tripled = D.interval_multiply(i, 3)
    more = D.interval_add(tripled, D.interval_literal("1-0", "YEAR TO MONTH"))
    half = D.interval_divide(tripled, 2)
    return t.events.select("event_id", more["months"].cast("bigint").alias("months"), half["days"].cast("bigint").alias("days"), D.extract_from_interval("YEAR", tripled).alias("years"))


@query("dt_session_clock", "SELECT TIMESTAMP '2024-01-01 00:00:00' AS now, DATE '2024-01-01' AS today, CAST(0 AS BIGINT) AS clock")
def dt_session_clock(t):
    from ..session import Session

    s = Session(t.spark)
    return t.spark.range(1).select(s.current_timestamp().alias("now"), s.current_date().alias("today"), s.current_time_micros().cast("bigint").alias("clock"))


@query("generate_uuid", """SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT event_id, md5('txn7/' || event_id) AS h FROM events)""")
def generate_uuid(t):
    return t.events.select("event_id", D.generate_uuid("txn7", "event_id").alias("id"))


@query("geo_distance", """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, round(sqrt(power(CAST(embedding[1] AS DOUBLE) - 0.5, 2) + power(CAST(embedding[2] AS DOUBLE) + 0.25, 2)), 10) AS d FROM embeddings""")
def geo_distance(t):
    p = G.point(F.col("embedding")[0], F.col("embedding")[1])
    return t.embeddings.select("vec_id", G.get_x(p).alias("x"), G.get_y(p).alias("y"), F.round(G.calc_distance(p, G.point(0.5, -0.25)), 10).alias("d"))


@query("dt_time", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + CAST(second(ts) AS BIGINT)) * 1000000 AS t, ((hour(ts) * 3600 + minute(ts) * 60 + CAST(second(ts) AS BIGINT)) * 1000000 + 43200000000) % 86400000000 AS later FROM events")
def dt_time(t):
    rows = t.events.select("event_id", D.to_time(F.date_format("ts", "HH:mm:ss"), "%H:%M:%S").alias("t"))
    return rows.select("event_id", "t", D.add_to_time("t", D.interval_literal("12", "HOUR")).alias("later"))
