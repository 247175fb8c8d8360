"""Queries over statements that change tables, and over their constraints: what the table holds afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml as W
from ..operators import relational as R
from ..sources import tables as S
from .catalogue import query


@query("dml_insert_select", "SELECT * FROM nation UNION ALL SELECT CAST(n_nationkey + 100 AS INTEGER), upper(n_name), CAST(9 AS INTEGER) FROM nation WHERE n_regionkey = 2")
def dml_insert_select(t):
    rows = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey") + 100, F.upper("n_name"))
    return W.insert(t.nation, rows, ["n_nationkey", "n_name"], {"n_regionkey": 9})


@query("dml_insert_values", "SELECT * FROM region UNION ALL SELECT CAST(7 AS INTEGER), 'NEW' UNION ALL SELECT CAST(8 AS INTEGER), NULL")
def dml_insert_values(t):
    return W.insert(t.region, S.values(t.spark, [(7, "NEW"), (8, None)], "int, string"))


@query("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(t):
    return W.update(t.customer, {"c_acctbal": F.col("c_acctbal") * 2, "c_mktsegment": "BUILT"}, F.col("c_mktsegment") == "BUILDING")


@query("dml_delete", "SELECT * FROM orders WHERE NOT COALESCE(NULLIF(o_orderstatus, 'P') = 'F', FALSE)")
def dml_delete(t):
    return W.delete(t.orders, F.nullif(F.col("o_orderstatus"), F.lit("P")) == "F")


@query("dml_delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def dml_delete_cascade(t):
    tables = {"customer": t.customer.select("c_custkey", "c_nationkey"), "orders": t.orders.select("o_orderkey", "o_custkey")}
    key = W.ForeignKey("orders", "o_custkey", "customer", "c_custkey", "CASCADE")
    return W.delete_with_keys(tables, "customer", F.col("c_nationkey") == 3, [key])["orders"]


@query("dml_delete_set_null", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def dml_delete_set_null(t):
    tables = {"customer": t.customer.select("c_custkey", "c_nationkey"), "orders": t.orders.select("o_orderkey", "o_custkey")}
    key = W.ForeignKey("orders", "o_custkey", "customer", "c_custkey", "SET NULL")
    return W.delete_with_keys(tables, "customer", F.col("c_nationkey") == 3, [key])["orders"]


@query("unique_violations", "SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2 HAVING COUNT(*) > 1")
def unique_violations(t):
    return W.unique_violations(t.customer, ["c_nationkey", "c_mktsegment"])


@query("fk_orphans", "SELECT o_orderkey, o_custkey * 2 AS o_custkey FROM orders WHERE o_custkey * 2 NOT IN (SELECT c_custkey FROM customer)")
def fk_orphans(t):
    return W.orphans(t.orders.select("o_orderkey", (F.col("o_custkey") * 2).alias("o_custkey")), "o_custkey", t.customer, "c_custkey")


def _statements(t, names, *texts):
    """A session over the tables, with the statements run in turn; those that raise a constraint give no error here."""
    from ..session import Session

    session = Session(t.spark)
    session.load_tables(t.folder, names)
    refused = 0
    for text in texts:
        try:
            session.execute(text)
        except W.ConstraintError:
            refused += 1
    return session, refused


@query("ctas", "SELECT region + 1 AS region, n FROM (SELECT n_regionkey AS region, COUNT(*) AS n FROM nation GROUP BY 1) UNION ALL SELECT 99, 0")
def ctas(t):
    session, _ = _statements(t, ["nation"], "CREATE TABLE ctas_regions AS SELECT n_regionkey AS region, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "UPDATE ctas_regions SET region = region + 1", "INSERT INTO ctas_regions VALUES (99, 0)")
    return session.sql("SELECT region, n FROM ctas_regions")


@query("dml_unique_index", "SELECT n_nationkey AS id, n_name AS name, CAST(2 AS BIGINT) AS refused FROM nation UNION ALL SELECT CAST(100 AS INTEGER), NULL, 2 UNION ALL SELECT CAST(101 AS INTEGER), NULL, 2")
def dml_unique_index(t):
    """The second statement of each pair gives a value twice and is refused; nulls are no values."""
    session, refused = _statements(
        t, ["nation"],
        "CREATE TABLE unique_nation (id INTEGER, name TEXT)",
        "INSERT INTO unique_nation SELECT n_nationkey, n_name FROM nation",
        "CREATE UNIQUE INDEX unique_nation_name ON unique_nation (name)",
        "INSERT INTO unique_nation SELECT n_nationkey + 500, n_name FROM nation",
        "UPDATE unique_nation SET name = 'same'",
        "INSERT INTO unique_nation VALUES (100, NULL), (101, NULL)",
    )
    return session.table("unique_nation").withColumn("refused", F.lit(refused).cast("bigint"))


@query("ddl_foreign_key", "SELECT n_nationkey AS id, n_regionkey AS region, CAST(3 AS BIGINT) AS refused FROM nation WHERE n_regionkey <> 2")
def ddl_foreign_key(t):
    """Orphans, the deletion of a parent that is referred to, and dropping its table are refused; CASCADE takes its children along."""
    session, refused = _statements(
        t, ["nation", "region"],
        "CREATE TABLE fk_region (id INTEGER, name TEXT, PRIMARY KEY (id))",
        "INSERT INTO fk_region SELECT r_regionkey, r_name FROM region",
        "CREATE TABLE fk_strict (id INTEGER PRIMARY KEY, region INTEGER, FOREIGN KEY (region) REFERENCES fk_region (id))",
        "INSERT INTO fk_strict VALUES (1, 77)",
        "INSERT INTO fk_strict VALUES (1, 1)",
        "DELETE FROM fk_region WHERE id = 1",
        "DROP TABLE fk_region",
        "CREATE TABLE fk_nation (id INTEGER PRIMARY KEY, region INTEGER, CONSTRAINT own FOREIGN KEY (region) REFERENCES fk_region (id) ON DELETE CASCADE)",
        "INSERT INTO fk_nation SELECT n_nationkey, n_regionkey FROM nation",
        "DELETE FROM fk_region WHERE id = 2",
        "DROP TABLE fk_region CASCADE",
    )
    return session.table("fk_nation").withColumn("refused", F.lit(refused).cast("bigint"))


@query("dialect_powers", "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * p_size AS cube, CAST(1024 AS BIGINT) AS two, CAST(factorial(p_size % 15) AS DECIMAL(38,0)) AS f, CAST('8683317618811886495518194401280000000' AS DECIMAL(38,0)) AS most FROM part")
def dialect_powers(t):
    return _dialect(t, "SELECT p_partkey, p_size ** 3 AS cube, 2 ** 10 AS two, (p_size % 15)! AS f, 33! AS most FROM part", "part")


@query("dialect_to_time", "SELECT o_orderkey, CAST(o_orderkey % 24 AS BIGINT) AS h, CAST(o_orderkey % 60 AS BIGINT) AS m FROM orders")
def dialect_to_time(t):
    t.orders.selectExpr("o_orderkey", "format_string('%02d:%02d:07', o_orderkey % 24, o_orderkey % 60) AS spelled").createOrReplaceTempView("__order_times")
    return _dialect(t, "SELECT o_orderkey, EXTRACT(HOUR FROM TO_TIME(spelled, '%H:%M:%S')) AS h, EXTRACT(MINUTE FROM TO_TIME(spelled, '%H:%M:%S')) AS m FROM __order_times")


@query("transactions", "SELECT n_nationkey AS id, n_name AS name, CAST(25 AS BIGINT) AS seen, CAST(1 AS BIGINT) AS refused FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT CAST(100 AS INTEGER), 'adhoc', 25, 1")
def transactions(t):
    """One of two transactions that delete from a table finishes, one is refused, one is cancelled; a reader sees its snapshot."""
    from ..transactions import Coordinator, TransactionError

    session, _ = _statements(t, ["nation"], "CREATE TABLE tx_nation (id INTEGER PRIMARY KEY, name TEXT, region INTEGER)", "INSERT INTO tx_nation SELECT n_nationkey, n_name, n_regionkey FROM nation")
    all_of_it = Coordinator(session)
    reader, first, second, third = all_of_it.begin_read_only(), *(all_of_it.begin_read_write() for _ in range(3))
    for one, region in ((first, 1), (second, 2), (third, 3)):
        one.execute(f"DELETE FROM tx_nation WHERE region = {region}")
    third.cancel()
    first.finish()
    refused = 0
    try:
        second.finish()
    except TransactionError:
        refused = 1
    all_of_it.adhoc("INSERT INTO tx_nation VALUES (100, 'adhoc', 0)")
    seen = reader.execute("SELECT COUNT(*) AS n FROM tx_nation").select(F.col("n").alias("seen"))
    return session.sql("SELECT id, name FROM tx_nation").crossJoin(F.broadcast(seen)).withColumn("refused", F.lit(refused).cast("bigint"))


@query("explain_plan", "SELECT TRUE AS has_scan, TRUE AS has_filter")
def explain_plan(t):
    session, _ = _statements(t, ["nation"])
    plan = session.explain("SELECT n_name FROM nation WHERE n_regionkey = 1")
    return t.spark.createDataFrame([("Scan" in plan, "Filter" in plan)], "has_scan boolean, has_filter boolean")


@query("migrate_versions", "SELECT n_nationkey AS id, n_name AS name, CAST(2 AS BIGINT) AS version FROM nation")
def migrate_versions(t):
    """A version runs once; an older one does not run after it."""
    session, _ = _statements(t, ["nation"], "CREATE TABLE migrated (id INTEGER)")
    session.migrate(1, "ALTER TABLE migrated ADD COLUMN name TEXT")
    session.migrate(2, "INSERT INTO migrated SELECT n_nationkey, n_name FROM nation")
    session.migrate(2, "DELETE FROM migrated")
    session.migrate(1, "DELETE FROM migrated")
    return session.table("migrated").withColumn("version", F.lit(session.migrations.version).cast("bigint"))


@query("alter_table", "SELECT n_nationkey, n_name AS title, CAST(0 AS BIGINT) AS added FROM nation")
def alter_table(t):
    return W.drop_column(W.rename_column(W.add_column(t.nation, "added", "bigint", 0), "n_name", "title"), "n_regionkey")


@query("dialect_select", "SELECT o_custkey, COUNT(*) AS n, CAST(SUM(o_orderkey // 4) AS BIGINT) AS q FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 100000) GROUP BY o_custkey ORDER BY n DESC NULLS FIRST, o_custkey NULLS LAST LIMIT 10")
def dialect_select(t):
    from ..session import Session

    t.orders.createOrReplaceTempView("__orders")
    return Session(t.spark).sql("SELECT o_custkey, COUNT(*) AS n, SUM(o_orderkey / 4) AS q FROM __orders WHERE (o_orderstatus = 'F') XOR (o_totalprice > 100000) GROUP BY o_custkey ORDER BY n DESC, o_custkey FETCH FIRST 10 ROWS ONLY")


@query("semi_join", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def semi_join(t):
    return R.semi(t.nation, t.region.where("r_name LIKE 'A%'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name")


@query("nothing", "SELECT r_regionkey, r_name FROM region WHERE FALSE")
def nothing(t):
    return S.nothing(t.spark, "r_regionkey int, r_name string")


@query("dml_insert_defaults", "SELECT * FROM region UNION ALL SELECT CAST(NULL AS INTEGER), 'unnamed'")
def dml_insert_defaults(t):
    return W.insert_defaults(t.region, {"r_name": "unnamed"})


@query("dml_delete_set_default", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation")
def dml_delete_set_default(t):
    tables = {"region": t.region, "nation": t.nation.select("n_nationkey", "n_regionkey")}
    key = W.ForeignKey("nation", "n_regionkey", "region", "r_regionkey", "SET DEFAULT")
    return W.delete_with_keys(tables, "region", F.col("r_regionkey") == 2, [key], {"nation.n_regionkey": 0})["nation"]


def _dialect(t, text, *names):
    from ..session import Session

    session = Session(t.spark)
    session.load_tables(t.folder, names)
    return session.sql(text)


@query("dialect_values", "SELECT * FROM (VALUES (CAST(2 AS INTEGER), 'b'), (3, 'c')) AS v(column1, column2)")
def dialect_values(t):
    return _dialect(t, "VALUES (1, 'a'), (3, 'c'), (2, 'b') ORDER BY column1 DESC LIMIT 2")


@query("dialect_unnest", "SELECT p_partkey, UNNEST(string_split(p_name, ' ')) AS word FROM part WHERE p_size > 40")
def dialect_unnest(t):
    t.part.selectExpr("p_partkey", "p_size", "split(p_name, ' ') AS words").createOrReplaceTempView("__part_words")
    return _dialect(t, "SELECT p.p_partkey, w.word FROM __part_words p JOIN UNNEST(p.words) AS w(word) WHERE p.p_size > 40")


@query("dialect_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC NULLS FIRST, o_orderkey")
def dialect_distinct_on(t):
    return _dialect(t, "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "orders")


@query("dialect_functions", """SELECT p_partkey, substring(p_name, 1, 3) AS head, p_name || '/' || p_brand AS both, CAST(p_size // 4 AS BIGINT) AS quarter, p_size BETWEEN 5 AND 20 AS mid,
CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, xor(p_size, 3) AS bits, COALESCE(NULLIF(p_size, 7), -1) AS filled FROM part WHERE p_type ILIKE '%steel%' OR p_size IN (1, 2, 3)""")
def dialect_functions(t):
    return _dialect(t, """SELECT p_partkey, SUBSTR(p_name, 0, 3) AS head, p_name || '/' || p_brand AS both, CAST(p_size / 4 AS BIGINT) AS quarter, p_size BETWEEN 5 AND 20 AS mid,
        CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind, p_size ^ 3 AS bits, COALESCE(NULLIF(p_size, 7), -1) AS filled FROM part WHERE p_type ILIKE '%steel%' OR p_size IN (1, 2, 3)""", "part")


@query("dialect_subqueries", """SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation
WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)""")
def dialect_subqueries(t):
    return _dialect(t, """SELECT n_name, (SELECT COUNT(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation
        WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)""", "nation", "customer", "region", "supplier")


@query("dialect_outer_joins", """SELECT n_name, r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 2) r ON n_regionkey = r_regionkey AND n_nationkey > 10""")
def dialect_outer_joins(t):
    return _dialect(t, "SELECT n_name, r.r_name FROM nation FULL JOIN (SELECT * FROM region WHERE r_regionkey > 2) AS r ON n_regionkey = r.r_regionkey AND n_nationkey > 10", "nation", "region")


@query("dialect_aggregates", """SELECT l_returnflag, COUNT(DISTINCT l_linenumber) AS n, CAST(SUM(l_linenumber) // COUNT(*) AS BIGINT) AS mean, ROUND(STDDEV_SAMP(l_quantity), 8) AS s, MIN(l_shipdate) AS first FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 10""")
def dialect_aggregates(t):
    return _dialect(t, "SELECT l_returnflag, COUNT(DISTINCT l_linenumber) AS n, SUM(l_linenumber) / COUNT(*) AS mean, ROUND(STDEV(l_quantity), 8) AS s, MIN(l_shipdate) AS first FROM lineitem GROUP BY l_returnflag HAVING COUNT(*) > 10", "lineitem")
