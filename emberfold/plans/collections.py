"""Queries over lists, maps, structs and JSON. Results are written as text, so that engines' nested types need not agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import collections as C
from ..functions import strings as S
from .catalogue import query

#: A list for each order: its key's remainders, one of them possibly null.
SQL_LIST = "[o_orderkey % 5, o_orderkey % 3, NULLIF(o_orderkey % 4, 2), o_orderkey % 5]"


def _list():
    k = F.col("o_orderkey")
    return F.array(k % 5, k % 3, F.nullif(k % 4, F.lit(2)), k % 5)


def _text(xs):
    return F.array_join(F.transform(xs, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")


def _sql_text(sql: str) -> str:
    return f"COALESCE(array_to_string(list_transform({sql}, lambda x: COALESCE(CAST(x AS VARCHAR), 'null')), ','), '')"


_LISTS = {
    "arr_append": (_sql_text("list_append(xs, 9)"), lambda xs: C.append(xs, F.lit(9).cast("long"))),
    "arr_prepend": (_sql_text("list_prepend(9, xs)"), lambda xs: C.prepend(F.lit(9).cast("long"), xs)),
    "arr_sort": (_sql_text("list_sort(xs, 'ASC', 'NULLS LAST')"), lambda xs: C.sort(xs)),
    "arr_sort_desc": (_sql_text("list_sort(xs, 'DESC', 'NULLS FIRST')"), lambda xs: C.sort(xs, "DESC")),
    "arr_slice": (_sql_text("xs[2:3]"), lambda xs: C.slice_(xs, 1, 3)),
    "arr_slice_negative": (_sql_text("xs[2:4]"), lambda xs: C.slice_(xs, -3)),
    "arr_splice": (_sql_text("list_concat(xs[1:1], [CAST(7 AS BIGINT), 8], xs[4:4])"), lambda xs: C.splice(xs, 1, 2, F.array(F.lit(7).cast("long"), F.lit(8).cast("long")))),
    "arr_take": (_sql_text("xs[1:2]"), lambda xs: C.take(xs, 2)),
    "arr_skip": (_sql_text("xs[4:4]"), lambda xs: C.skip(xs, 3)),
    "arr_flatten": (_sql_text("list_concat(xs, [o_orderkey])"), lambda xs: C.flatten(F.array(xs, F.array("o_orderkey")))),
    "arr_reverse": (_sql_text("list_reverse(xs)"), lambda xs: S.reverse(xs)),
    "arr_concat": (_sql_text("list_concat(xs, xs)"), lambda xs: S.concat_lists(xs, xs, F.when(F.lit(False), xs))),
}
for _name, (_sql, _make) in _LISTS.items():
    query(_name, f"SELECT o_orderkey, {_sql} AS r FROM (SELECT o_orderkey, {SQL_LIST} AS xs FROM orders)")(lambda t, make=_make: t.orders.select("o_orderkey", _text(make(_list())).alias("r")))


@query("arr_dedup", """SELECT o_orderkey, CASE WHEN b = a THEN a::VARCHAR ELSE a || ',' || b END || CASE WHEN c IS NULL THEN ',null' WHEN c = a OR c = b THEN '' ELSE ',' || c END AS r
FROM (SELECT o_orderkey, o_orderkey % 5 AS a, o_orderkey % 3 AS b, NULLIF(o_orderkey % 4, 2) AS c FROM orders)""")
def arr_dedup(t):
    return t.orders.select("o_orderkey", _text(C.dedup(_list())).alias("r"))


@query("arr_find", f"SELECT o_orderkey, CAST(NULLIF(COALESCE(list_position(xs, 2), 0), 0) - 1 AS BIGINT) AS at, COALESCE(list_contains(list_filter(xs, lambda x: x IS NOT NULL), 2), FALSE) AS has, xs[1] AS first, CAST(NULL AS BIGINT) AS beyond, CAST(len(xs) AS BIGINT) AS n FROM (SELECT o_orderkey, {SQL_LIST} AS xs FROM orders)")
def arr_find(t):
    xs, two = _list(), F.lit(2).cast("long")
    return t.orders.select("o_orderkey", C.find_idx(xs, two).alias("at"), F.coalesce(C.contains(xs, two), F.lit(False)).alias("has"), C.element(xs, 0).alias("first"), C.element(xs, 10).alias("beyond"), S.length(xs, "list").alias("n"))


@query("arr_embeddings", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[1] AS first, embedding[3] AS third FROM embeddings")
def arr_embeddings(t):
    return t.embeddings.select("vec_id", S.length("embedding", "list").alias("n"), C.element("embedding", 0).alias("first"), C.element("embedding", 2).alias("third"))


def _map():
    return F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))


@query("map_keys_values", "SELECT o_orderkey, 'priority,status' AS ks, array_to_string(list_sort([o_orderstatus, o_orderpriority]), ',') AS vs, o_orderstatus AS s, CAST(NULL AS VARCHAR) AS none, TRUE AS has, CAST(2 AS BIGINT) AS n FROM orders")
def map_keys_values(t):
    m = _map()
    return t.orders.select("o_orderkey", F.array_join(F.array_sort(C.keys(m)), ",").alias("ks"), F.array_join(F.array_sort(C.values(m)), ",").alias("vs"), C.map_element(m, "status").alias("s"), C.map_element(m, "absent").alias("none"), C.contains_key(m, "status").alias("has"), S.length(m, "map").alias("n"))


@query("map_entries", "SELECT o_orderkey, 'priority=' || o_orderpriority || ';status=' || o_orderstatus AS es, 'b' AS last FROM orders")
def map_entries(t):
    es = F.array_sort(F.transform(C.entries(_map()), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    twice = C.from_entries(F.array(*(F.struct(F.lit("k").alias("key"), F.lit(v).alias("value")) for v in "ab")))
    return t.orders.select("o_orderkey", F.array_join(es, ";").alias("es"), C.map_element(twice, "k").alias("last"))


@query("map_merge", "SELECT o_orderkey, 'new' AS status, o_orderpriority AS priority FROM orders")
def map_merge(t):
    m = C.merge(_map(), F.when(F.lit(False), _map()), C.literal_map({"status": "new", 3: "dropped"}))
    return t.orders.select("o_orderkey", C.map_element(m, "status").alias("status"), C.map_element(m, "priority").alias("priority"))


@query("struct_fields", "SELECT o_orderkey, 'k,p' AS names, o_orderpriority AS p FROM orders")
def struct_fields(t):
    rows = t.orders.select("o_orderkey", F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p")).alias("s"))
    return rows.select("o_orderkey", F.array_join(C.fields(rows.schema["s"].dataType), ",").alias("names"), F.col("s.p").alias("p"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS BIGINT) AS absent FROM events")
def json_props(t):
    return t.events.select("event_id", C.unwrap_json("props", "k", "bigint").alias("k"), C.unwrap_json("props", "absent", "bigint").alias("absent"))


@query("unwrap_path", "SELECT o_orderkey, o_orderkey % 3 AS x, CAST(NULL AS BIGINT) AS miss FROM orders")
def unwrap_path(t):
    nested = F.struct(F.create_map(F.lit("xs"), _list()).alias("m"))
    return t.orders.select("o_orderkey", C.unwrap(nested, "m.xs.1", "sml").alias("x"), C.unwrap(nested, "m.ys.1", "sml").alias("miss"))
