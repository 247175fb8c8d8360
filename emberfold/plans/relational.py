"""Queries over scans, predicates, joins, subqueries, aggregates and ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import aggregates as A
from ..operators import relational as R
from ..sources import tables as S
from .catalogue import query


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice")
    sums = (A.sum_("l_quantity").alias("sum_qty"), F.round(A.sum_(price), 2).alias("sum_base"), F.round(A.sum_(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(A.avg("l_discount"), 6).alias("avg_disc"), A.count().alias("n"))
    return R.order_by(rows.groupBy("l_returnflag", "l_linestatus").agg(*sums), "l_returnflag", "l_linestatus")


@query("scan_table", "SELECT * FROM nation")
def scan_table(t):
    return t.nation


@query("series", "SELECT CAST(range AS BIGINT) AS n FROM range(1, 1001)")
def series(t):
    return S.series(t.spark, 1000)


@query("select_without_from", "SELECT CAST(42 AS INTEGER) AS a, 'x' AS b")
def select_without_from(t):
    return S.one_row(t.spark).select(F.lit(42).alias("a"), F.lit("x").alias("b"))


@query("values_inline", "SELECT * FROM (VALUES (CAST(1 AS INTEGER), 'one'), (2, 'two'), (NULL, 'none')) AS v(column1, column2)")
def values_inline(t):
    return S.values(t.spark, [(1, "one"), (2, "two"), (None, "none")], "int, string")


@query("index_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def index_scan(t):
    return S.index_scan(t.orders, {"o_custkey": 7}).select("o_orderkey", "o_custkey")


@query("index_range_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 10 AND o_custkey <= 20")
def index_range_scan(t):
    return S.index_scan(t.orders, column="o_custkey", low=10, high=20, low_open=True).select("o_orderkey", "o_custkey")


@query("inline_view", "SELECT a.k, a.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) AS a WHERE a.n > 15")
def inline_view(t):
    return t.orders.groupBy(F.col("o_custkey").alias("k")).agg(A.count().alias("n")).alias("a").where("a.n > 15")


@query("proj_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity + 1 AS more FROM lineitem")
def proj_expr(t):
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return t.lineitem.select("l_orderkey", "l_linenumber", price.alias("charge"), (F.col("l_quantity") + 1).alias("more"))


@query("proj_star", "SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
def proj_star(t):
    n = t.nation.alias("n")
    return n.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n.*", "r_name")




@query("filter_3vl", """SELECT o_orderkey FROM (SELECT *, NULLIF(o_orderstatus, 'P') AS s FROM orders)
WHERE (s = 'F' OR o_totalprice > 200000) AND NOT (s = 'O' AND o_totalprice < 50000) AND ((s = 'F') <> (o_totalprice > 100000))""")
def filter_3vl(t):
    s, price = F.col("s"), F.col("o_totalprice")
    rows = t.orders.withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return rows.where(((s == "F") | (price > 200000)) & ~((s == "O") & (price < 50000)) & P.xor(s == "F", price > 100000)).select("o_orderkey")


@query("comparisons", """SELECT l_orderkey, l_linenumber, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge FROM lineitem""")
def comparisons(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", (q == 10).alias("eq"), (q != 10).alias("ne"), (q < 10).alias("lt"), (q <= 10).alias("le"), (q > 10).alias("gt"), (q >= 10).alias("ge"))


@query("pred_in_list_null", """SELECT p_partkey, CASE WHEN p_size IN (1, 2, NULL) THEN 'yes' WHEN NOT (p_size IN (1, 2, NULL)) THEN 'no' ELSE 'unknown' END AS hit, p_size NOT IN (3, 4) AS other FROM part""")
def pred_in_list_null(t):
    hit = P.in_list("p_size", [1, 2, None])
    return t.part.select("p_partkey", F.when(hit, "yes").when(~hit, "no").otherwise("unknown").alias("hit"), (~P.in_list("p_size", [3, 4])).alias("other"))


@query("pred_between", """SELECT p_partkey, CASE WHEN s IS NULL THEN NULL ELSE s BETWEEN 10 AND 20 END AS hit FROM (SELECT p_partkey, NULLIF(p_size, 15) AS s FROM part)""")
def pred_between(t):
    return t.part.select("p_partkey", P.between(F.nullif(F.col("p_size"), F.lit(15)), 10, 20).alias("hit"))


@query("pred_like", r"SELECT p_partkey FROM part WHERE p_type LIKE '%A_E%' AND p_name NOT LIKE 'x\_%' ESCAPE '\'")
def pred_like(t):
    return t.part.where(P.like("p_type", "%A_E%") & ~P.like("p_name", r"x\_%")).select("p_partkey")


@query("pred_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%u%d%'")
def pred_ilike(t):
    return t.customer.where(P.ilike("c_mktsegment", "%u%d%")).select("c_custkey")


@query("pred_is_null", "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') IS NULL AS missing, NULLIF(o_orderstatus, 'O') IS NOT NULL AS there FROM orders")
def pred_is_null(t):
    s = F.nullif(F.col("o_orderstatus"), F.lit("O"))
    return t.orders.select("o_orderkey", s.isNull().alias("missing"), s.isNotNull().alias("there"))


@query("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
def case_simple(t):
    s = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "O", 1).when(s == "F", 2).alias("code"))


@query("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def case_searched(t):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 300000, "high").when(p > 100000, "middle").otherwise("low").alias("band"))


@query("cast_matrix", """SELECT p_partkey, CAST(p_size AS BIGINT) AS big, CAST(p_size AS DOUBLE) AS dbl, CAST(p_size AS VARCHAR) AS txt, CAST(TRUNC(p_retailprice) AS INTEGER) AS whole, CAST(p_retailprice AS DECIMAL(38,10)) AS dec, CAST('yes' AS VARCHAR) = 'yes' AS flag FROM part""")
def cast_matrix(t):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select("p_partkey", size.cast("bigint").alias("big"), size.cast("double").alias("dbl"), size.cast("string").alias("txt"), price.cast("int").alias("whole"), price.cast("decimal(38,10)").alias("dec"), F.lit("yes").cast("boolean").alias("flag"))


@query("parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000")
def parameters(t):
    t.orders.createOrReplaceTempView("__orders")
    return t.spark.sql("SELECT o_orderkey FROM __orders WHERE o_custkey = ? AND o_totalprice > ?", args=[7, 1000.0])


BIG = "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000"


def _big(t):
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000))


# Every row of both tables takes part; cheap orders have a null key, so they and some customers have no match.
for _how in ("inner", "left", "right", "full"):

    def _joined(t, how=_how):
        right = t.orders.withColumn("key", F.when(F.col("o_totalprice") > 250000, F.col("o_custkey")))
        return R.join(t.customer, right, F.col("c_custkey") == F.col("key"), how).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")

    query(f"join_{_how}", f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer {_how.upper()} JOIN orders ON c_custkey = CASE WHEN o_totalprice > 250000 THEN o_custkey END")(_joined)


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return R.join(t.region, t.nation, how="cross").select("r_name", "n_name")


@query("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return R.join(a, b, on).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("join_left_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a LEFT JOIN region b ON a.n_regionkey < b.r_regionkey AND b.r_name > 'C'")
def join_left_theta(t):
    on = (F.col("n_regionkey") < F.col("r_regionkey")) & (F.col("r_name") > "C")
    return R.join(t.nation, t.region, on, "left").select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"))


@query("join_self", "SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.c_custkey = a.c_custkey + 1")
def join_self(t):
    a, b = t.customer.alias("a"), t.customer.alias("b")
    on = (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")) & (F.col("b.c_custkey") == F.col("a.c_custkey") + 1)
    return R.join(a, b, on).select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b"))


@query("join_null_keys", "SELECT a.k AS a, b.k AS b FROM (SELECT DISTINCT NULLIF(n_regionkey, 1) AS k FROM nation) a FULL JOIN (SELECT NULLIF(r_regionkey, 2) AS k FROM region) b ON a.k = b.k")
def join_null_keys(t):
    a = t.nation.select(F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k")).distinct().alias("a")
    b = t.region.select(F.nullif(F.col("r_regionkey"), F.lit(2)).alias("k")).alias("b")
    return R.join(a, b, F.col("a.k") == F.col("b.k"), "full").select(F.col("a.k").alias("a"), F.col("b.k").alias("b"))


@query("join_unnest", "SELECT p_partkey, UNNEST(string_split(p_name, ' ')) AS word FROM part")
def join_unnest(t):
    return R.unnest(t.part.select("p_partkey", F.split("p_name", " ").alias("words")), "words", "word").select("p_partkey", "word")


@query("join_unnest_left", "SELECT p_partkey, w.word FROM part LEFT JOIN LATERAL (SELECT UNNEST(CASE WHEN p_size > 25 THEN string_split(p_name, ' ') ELSE [] END) AS word) w ON TRUE")
def join_unnest_left(t):
    words = F.when(F.col("p_size") > 25, F.split("p_name", " ")).otherwise(F.array().cast("array<string>"))
    return R.unnest(t.part.select("p_partkey", words.alias("words")), "words", "word", outer=True).select("p_partkey", "word")


@query("sub_in", f"SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM ({BIG}))")
def sub_in(t):
    return R.semi(t.customer, _big(t), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("sub_not_in", f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM ({BIG}))")
def sub_not_in(t):
    return R.not_in(t.customer, _big(t).select("o_custkey"), "c_custkey", "o_custkey").select("c_custkey")


@query("sub_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 1) FROM orders)")
def sub_not_in_null(t):
    right = t.orders.select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k"))
    return R.not_in(t.customer, right, "c_custkey", "k").select("c_custkey")


@query("sub_exists", f"SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM ({BIG}) o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30)")
def sub_exists(t):
    return R.semi(t.customer, _big(t), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > F.col("c_acctbal") * 30)).select("c_custkey")


@query("sub_not_exists", f"SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM ({BIG}) o WHERE o.o_custkey = c.c_custkey)")
def sub_not_exists(t):
    return R.anti(t.customer, _big(t), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")


@query("sub_scalar", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)")
def sub_scalar(t):
    t.part.createOrReplaceTempView("__part")
    return t.spark.sql("SELECT p_partkey FROM __part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM __part)")


@query("sub_correlated", "SELECT o_orderkey, (SELECT COUNT(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS n FROM orders")
def sub_correlated(t):
    lines = t.lineitem.where("l_quantity > 25").groupBy("l_orderkey").agg(A.count().alias("n"))
    return R.join(t.orders, lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))




def _flag(t):
    return t.lineitem.withColumn("q", F.nullif(F.col("l_quantity"), F.lit(10.0))).groupBy("l_returnflag")


Q = "(SELECT *, NULLIF(l_quantity, 10.0) AS q FROM lineitem)"
_AGGREGATES = {
    "agg_count": ("COUNT(*) AS n, COUNT(q) AS nq", lambda: [A.count().alias("n"), A.count("q").alias("nq")]),
    "agg_count_distinct": ("COUNT(DISTINCT q) AS n", lambda: [A.count_distinct("q").alias("n")]),
    "agg_sum": ("SUM(q) AS s, CAST(SUM(l_linenumber) AS BIGINT) AS lines", lambda: [A.sum_("q").alias("s"), A.sum_("l_linenumber", "bigint").alias("lines")]),
    "agg_sum_distinct": ("SUM(DISTINCT q) AS s", lambda: [A.sum_distinct("q").alias("s")]),
    "agg_avg": ("ROUND(AVG(q), 8) AS a", lambda: [F.round(A.avg("q"), 8).alias("a")]),
    "agg_avg_distinct": ("ROUND(AVG(DISTINCT q), 8) AS a", lambda: [F.round(A.avg_distinct("q"), 8).alias("a")]),
    "agg_min_max": ("MIN(q) AS low, MAX(q) AS high, MIN(DISTINCT q) AS low_d, MAX(DISTINCT q) AS high_d, MIN(l_shipdate) AS first, MAX(l_linestatus) AS last", lambda: [A.minimum("q").alias("low"), A.maximum("q").alias("high"), A.minimum("q").alias("low_d"), A.maximum("q").alias("high_d"), A.minimum("l_shipdate").alias("first"), A.maximum("l_linestatus").alias("last")]),
    "agg_stdev": ("ROUND(STDDEV_SAMP(q), 8) AS s", lambda: [F.round(A.stdev("q"), 8).alias("s")]),
    "agg_variance": ("ROUND(VAR_SAMP(q), 6) AS v", lambda: [F.round(A.variance("q"), 6).alias("v")]),
}
for _name, (_sql, _make) in _AGGREGATES.items():
    query(_name, f"SELECT l_returnflag, {_sql} FROM {Q} GROUP BY l_returnflag")(lambda t, make=_make: _flag(t).agg(*make()))


@query("agg_spread_distinct", f"SELECT l_returnflag, ROUND(STDDEV_SAMP(DISTINCT q), 8) AS s, ROUND(VAR_SAMP(DISTINCT q), 6) AS v FROM {Q} GROUP BY l_returnflag")
def agg_spread_distinct(t):
    rows = t.lineitem.select("l_returnflag", F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("q"))
    return A.distinct_then(rows, ["l_returnflag"], "q", s=F.round(A.stdev("q"), 8), v=F.round(A.variance("q"), 6))


@query("agg_count_distinct_rows", "SELECT COUNT(*) AS n FROM (SELECT DISTINCT NULLIF(l_quantity, 10.0) AS q, l_returnflag FROM lineitem)")
def agg_count_distinct_rows(t):
    rows = t.lineitem.select(F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("q"), "l_returnflag")
    return rows.agg(A.count_distinct_rows(rows).alias("n"))


@query("agg_array_agg", "SELECT o_custkey, array_to_string(list_sort(list(COALESCE(CAST(NULLIF(o_orderkey % 5, 0) AS VARCHAR), 'null'))), ',') AS xs FROM orders GROUP BY o_custkey")
def agg_array_agg(t):
    xs = A.array_agg(F.nullif(F.col("o_orderkey") % 5, F.lit(0)))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.transform(xs, lambda x: F.coalesce(x.cast("string"), F.lit("null")))), ",").alias("xs"))


@query("having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 8 AND SUM(o_totalprice) > 1000000")
def having(t):
    grouped = t.orders.groupBy("o_custkey").agg(A.count().alias("n"), A.sum_("o_totalprice").alias("s"))
    return grouped.where("n > 8 AND s > 1000000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query("group_by_expr", "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, o_totalprice > 150000 AS big, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def group_by_expr(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_totalprice") > 150000).alias("big")).agg(A.count().alias("n"))


@query("agg_of_expr", "SELECT l_returnflag, ROUND(SUM(l_extendedprice) / COUNT(*), 6) AS mean, CASE WHEN COUNT(*) > 100 THEN 'many' ELSE 'few' END AS size, SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::BIGINT AS cut FROM lineitem GROUP BY l_returnflag")
def agg_of_expr(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.round(A.sum_("l_extendedprice") / A.count(), 6).alias("mean"),
        F.when(A.count() > 100, "many").otherwise("few").alias("size"),
        A.sum_(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("cut"),
    )


@query("agg_empty_input", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MIN(l_quantity) AS low, STDDEV_SAMP(l_quantity) AS d FROM lineitem WHERE l_quantity < 0")
def agg_empty_input(t):
    return t.lineitem.where("l_quantity < 0").agg(A.count().alias("n"), A.sum_("l_quantity").alias("s"), A.minimum("l_quantity").alias("low"), A.stdev("l_quantity").alias("d"))


@query("group_empty_input", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
def group_empty_input(t):
    return t.lineitem.where("l_quantity < 0").groupBy("l_returnflag").agg(A.count().alias("n"))


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, NULLIF(l_linenumber, 3) AS k FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", F.nullif(F.col("l_linenumber"), F.lit(3)).alias("k")).distinct()


@query("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def distinct_on(t):
    return R.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [("o_totalprice", "DESC"), "o_orderkey"])


@query("distinct_on_ascending", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, s FROM (SELECT *, NULLIF(o_orderstatus, 'F') AS s FROM orders) ORDER BY o_custkey, s NULLS LAST, o_orderkey")
def distinct_on_ascending(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    return R.distinct_on(rows, ["o_custkey"], ["s", "o_orderkey"])


@query("order_nulls_asc", "SELECT o_orderkey, s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) ORDER BY s ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 5")
def order_nulls_asc(t):
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    return R.limit_offset(R.order_by(rows, "s", "o_orderkey"), 50, 5)


@query("order_nulls_desc", "SELECT o_orderkey, s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 50")
def order_nulls_desc(t):
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    return R.limit_offset(R.order_by(rows, ("s", "DESC"), "o_orderkey"), 50)


@query("order_ordinal", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 30")
def order_ordinal(t):
    return R.limit_offset(R.order_by(t.orders.select("o_custkey", "o_orderkey"), (1, "DESC"), 2), 30)


@query("order_nulls_asc_whole", "SELECT o_orderkey, s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) ORDER BY s ASC NULLS LAST, o_orderkey")
def order_nulls_asc_whole(t):
    return R.order_by(t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s")), "s", "o_orderkey")


@query("order_nulls_desc_whole", "SELECT o_orderkey, s FROM (SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders) ORDER BY s DESC NULLS FIRST, o_orderkey")
def order_nulls_desc_whole(t):
    return R.order_by(t.orders.select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s")), ("s", "DESC"), "o_orderkey")


@query("order_ordinal_whole", "SELECT o_custkey, o_orderkey FROM orders ORDER BY 1 DESC, 2")
def order_ordinal_whole(t):
    return R.order_by(t.orders.select("o_custkey", "o_orderkey"), (1, "DESC"), 2)


@query("order_by_aggregate", "SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 20")
def order_by_aggregate(t):
    return R.limit_offset(R.order_by(t.orders.groupBy("o_custkey").agg(A.count().alias("n")), ("n", "DESC"), "o_custkey"), 20).select("o_custkey")


@query("limit_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25 OFFSET 40")
def limit_offset(t):
    return R.limit_offset(R.order_by(t.part.select("p_partkey"), "p_partkey"), 25, 40)
