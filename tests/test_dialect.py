"""Statements in the engine's dialect, with results worked out by hand."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberfold.dialect import DialectError, translate
from emberfold.operators.dml import ConstraintError
from emberfold.session import Session
from emberfold.types import cast


@pytest.fixture
def session(spark):
    return Session(spark, datetime(2024, 3, 5, 6, 7, 8))


def one(session, text):
    return tuple(session.sql(text).first())


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT 7 / 2 AS a, -7 / 2 AS b, 7.0 / 2 AS c, -7 % 3 AS d", (3, -3, 3.5, -1)),
        ("SELECT 2 ** 3 ** 2 AS a, 5! AS b, 6 ^ 3 & 1 AS c, 1 + 2 * 3 AS d", (512.0, 120, 7, 7)),
        ("SELECT TRUE XOR FALSE AS a, NULL XOR TRUE AS b, NOT TRUE OR TRUE AS c", (True, None, True)),
        ("SELECT SUBSTR('hello', -10, 7) AS a, SUBSTR('hello', 0, 2) AS b, SUBSTR('hello', 9) AS c, SUBSTR('hello', -2) AS d", ("hello", "he", "", "lo")),
        ("SELECT CONCAT('a', NULL, 'b') AS a, CONCAT(NULL, 'b') AS b, 'a' || NULL AS c", ("ab", None, None)),
        ("SELECT TRIM(LEADING 'h' FROM 'hhello') AS a, TRIM('  x ') AS b, RTRIM('axx', 'x') AS c", ("ello", "x", "a")),
        ("SELECT SLICE([1, 2, 3, 4], -3, -1) AS a, SPLICE([1, 2, 3], 1, 1, [9]) AS b, TAKE([1, 2], 1) AS c, SKIP([1, 2], 1) AS d", ([2, 3], [1, 9, 3], [1], [2])),
        ("SELECT [10, 20][0] AS a, [10, 20][5] AS b, {'k': 1}['k'] AS c, FIND_IDX([5, 6], 6) AS d, FIND_IDX('abc', 'c') AS e", (10, None, 1, 1, 3)),
        ("SELECT DATE '2024-01-31' + INTERVAL '1' MONTH AS a, DATE '2024-01-31' - 1 AS b", (date(2024, 3, 1), date(2024, 1, 30))),
        ("SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1 02:30' DAY TO MINUTE AS a", (datetime(2024, 1, 2, 2, 30),)),
        ("SELECT EXTRACT(SECOND FROM TIMESTAMP '2024-01-01 00:00:07.9') AS a, EXTRACT(YEAR FROM INTERVAL '1-3' YEAR TO MONTH) AS b", (7, 1)),
        ("SELECT NOW() AS a, CURRENT_DATE AS b", (datetime(2024, 3, 5, 6, 7, 8), date(2024, 3, 5))),
        ("SELECT 3 BETWEEN 1 AND NULL AS a, 3 IN (1, NULL) AS b, 3 NOT IN (1, 2) AS c, NULL IS NULL AS d", (None, None, True, True)),
        ("SELECT CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END AS a, CASE WHEN FALSE THEN 1 END AS b", ("b", None)),
        ("SELECT TO_DATE('05/03/2024', '%d/%m/%Y') AS a, CAST('12' AS INT) AS b, CAST(2.7 AS INT) AS c", (date(2024, 3, 5), 12, 2)),
        ("SELECT CALC_DISTANCE(POINT(0, 3), POINT(4, 0)) AS a, GET_X(POINT(1, 2)) AS b", (5.0, 1.0)),
        ("SELECT LENGTH('abc') AS a, LENGTH([1, 2]) AS b, IS_EMPTY('') AS c, SORT([3, NULL, 1]) AS d, SORT([3, NULL, 1], 'DESC') AS e", (3, 2, True, [1, 3, None], [None, 3, 1])),
    ],
)
def test_expressions(session, text, want):
    assert one(session, text) == want


def test_order_limit_and_distinct_on(session):
    assert [r[0] for r in session.sql("SELECT n FROM SERIES(5) ORDER BY n DESC LIMIT 2 OFFSET 1").collect()] == [4, 3]
    assert [r[0] for r in session.sql("SELECT n FROM SERIES(3) ORDER BY n FETCH FIRST 2 ROWS ONLY").collect()] == [1, 2]
    rows = session.sql("SELECT column1 AS v FROM (VALUES (2), (NULL), (1)) AS t ORDER BY v").collect()
    assert [r[0] for r in rows] == [1, 2, None]
    rows = session.sql("SELECT column1 AS v FROM (VALUES (2), (NULL), (1)) AS t ORDER BY v DESC").collect()
    assert [r[0] for r in rows] == [None, 2, 1]
    rows = session.sql("SELECT DISTINCT ON (k) n % 2 AS k, n FROM (SELECT n, n % 2 AS k FROM SERIES(5)) AS s ORDER BY k, n DESC").collect()
    assert sorted(map(tuple, rows)) == [(0, 4), (1, 5)]


def test_parameters(session):
    assert session.sql("SELECT n FROM SERIES(5) WHERE n > ? AND n < ?", [2, 4]).collect()[0][0] == 3


def test_statements(session):
    run = session.execute
    run("CREATE TABLE team (id INTEGER PRIMARY KEY, name TEXT NOT NULL, size INT DEFAULT 5)")
    run("CREATE TABLE player (id INTEGER PRIMARY KEY, team INT REFERENCES team(id) ON DELETE CASCADE, tags TEXT[])")
    run("INSERT INTO team (id, name) VALUES (1, 'a'), (2, 'b')")
    run("INSERT INTO player VALUES (10, 1, ['x', 'y']), (11, 2, NULL), (12, NULL, [])")
    assert sorted(map(tuple, run("SELECT * FROM team").collect())) == [(1, "a", 5), (2, "b", 5)]
    assert [tuple(r) for r in run("SELECT p.id, t.tag FROM player p JOIN UNNEST(p.tags) AS t(tag) ORDER BY tag").collect()] == [(10, "x"), (10, "y")]
    assert run("SELECT p.id, t.tag FROM player p LEFT JOIN UNNEST(p.tags) AS t(tag)").count() == 4
    with pytest.raises(ConstraintError):
        run("INSERT INTO team (id, name) VALUES (1, 'again')")
    with pytest.raises(ConstraintError):
        run("INSERT INTO team (id) VALUES (3)")
    with pytest.raises(ConstraintError):
        run("INSERT INTO player VALUES (13, 99, NULL)")
    run("UPDATE team SET name = name || '!' WHERE id = 2")
    assert [r[0] for r in run("SELECT name FROM team ORDER BY id").collect()] == ["a", "b!"]
    run("DELETE FROM team WHERE id = 1")
    assert [r[0] for r in run("SELECT id FROM player ORDER BY id").collect()] == [11, 12]
    run("ALTER TABLE team RENAME COLUMN name TO title")
    run("ALTER TABLE team ADD COLUMN city TEXT DEFAULT 'here'")
    assert [tuple(r) for r in run("SELECT title, city FROM team").collect()] == [("b!", "here")]
    run("CREATE TABLE copy AS SELECT * FROM team")
    with pytest.raises(ConstraintError):
        run("DROP TABLE team")
    run("DROP TABLE team CASCADE")
    assert session.count("copy") == 1
    assert run("DROP TABLE IF EXISTS team") is None


@pytest.mark.parametrize("text", ["SELECT", "SELECT 1 +", "SELECT NOSUCH(1)", "SELECT n FROM SERIES(-1)", "FROM x", "SELECT 1 2 3"])
def test_what_cannot_be_read(text):
    with pytest.raises(DialectError):
        translate(text, datetime(2024, 1, 1))


@pytest.mark.parametrize("text", ["SELECT GREATEST(1, NULL) AS a", "SELECT SQRT(-1) AS a", "SELECT 1 << 64 AS a", "SELECT 1 / 0 AS a", "SELECT 34! AS a", "SELECT SUBSTR('a', 1, -1) AS a", "SELECT CAST(200 AS TINYINT) AS a"])
def test_errors_at_run_time(session, text):
    with pytest.raises(Exception):  # noqa: B017
        session.sql(text).collect()


def test_constraints_of_tables_and_indexes(spark):
    s = Session(spark)
    s.execute("CREATE TABLE parent_x (id INTEGER, name TEXT, CONSTRAINT pk PRIMARY KEY (id))")
    s.execute("CREATE TABLE plain_x (id INTEGER, name TEXT)")
    with pytest.raises(DialectError):
        s.execute("CREATE TABLE bad_x (id INTEGER, ref INTEGER, FOREIGN KEY (ref) REFERENCES plain_x (id))")
    with pytest.raises(DialectError):
        s.execute("CREATE TABLE bad_x (id INTEGER, ref INTEGER, FOREIGN KEY (ref) REFERENCES missing_x (id))")
    s.execute("CREATE TABLE child_x (id INTEGER PRIMARY KEY, ref INTEGER, UNIQUE (id, ref), FOREIGN KEY (ref) REFERENCES parent_x (id) ON DELETE SET NULL)")
    s.execute("INSERT INTO parent_x VALUES (1, 'a'), (2, 'b')")
    s.execute("INSERT INTO child_x VALUES (1, 1), (2, NULL)")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO child_x VALUES (3, 9)")
    s.execute("DELETE FROM parent_x WHERE id = 1")
    assert sorted(s.table("child_x").collect()) == [(1, None), (2, None)]
    with pytest.raises(ConstraintError):
        s.execute("DROP TABLE parent_x")
    s.execute("CREATE UNIQUE INDEX by_sum ON plain_x (id + 1)")
    s.execute("INSERT INTO plain_x VALUES (1, 'x'), (NULL, 'y'), (NULL, 'z')")
    with pytest.raises(ConstraintError):
        s.execute("INSERT INTO plain_x VALUES (1, 'again')")
    s.execute("DROP INDEX by_sum")
    s.execute("INSERT INTO plain_x VALUES (1, 'again')")
    with pytest.raises(ConstraintError):
        s.execute("CREATE UNIQUE INDEX by_id ON plain_x (id)")
    s.execute("DROP TABLE parent_x, child_x")
    assert "parent_x" not in s.tables and not s.foreign


def test_plans_do_not_grow_with_statements(spark):
    s = Session(spark)
    s.execute("CREATE TABLE many_x (id INTEGER)")
    s.execute("INSERT INTO many_x VALUES (1)")
    for _ in range(4):
        s.execute("UPDATE many_x SET id = id + 1")
    assert s.table("many_x").first()[0] == 5
    assert len(s.table("many_x")._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 2


def test_factorials_and_powers(spark):
    s = Session(spark)
    assert s.sql("SELECT 5! AS a, 21! AS b, 2 ** 3 AS c, 2.5 ** 2 AS d, 7 ** 0 AS e").first()[:] == (120, Decimal("51090942171709440000"), 8, 6.25, 1)
    for bad in ("SELECT 34! AS x", "SELECT 10 ** 19 AS x"):
        with pytest.raises(Exception):
            s.sql(bad).collect()


@pytest.mark.parametrize("text", ["1.2.3.4", "255.0.10.99", "::", "::1", "1::", "FE80::1:2", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4"])
def test_addresses(session, text):
    assert session.sql(f"SELECT CAST('{text}' AS INET) AS a").first()[0] == text.lower()
    assert session.spark.range(1).select(cast(F.lit(text), "INET")).first()[0] == text.lower()


@pytest.mark.parametrize("text", ["256.1.1.1", "1.2.3", "01.2.3.4", ":", ":1", "1:", "1::2::3", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::"])
def test_what_is_no_address(session, text):
    for df in (session.sql(f"SELECT CAST('{text}' AS INET) AS a"), session.spark.range(1).select(cast(F.lit(text), "INET"))):
        with pytest.raises(Exception, match="not an address"):
            df.collect()


def test_uuids_of_the_dialect(session):
    got = session.sql("SELECT CAST('{550E8400-E29B-41D4-A716-446655440000}' AS UUID) AS a, CAST(NULL AS UUID) AS b, CAST(NULL AS INET) AS c").first()
    assert got[:] == ("550e8400-e29b-41d4-a716-446655440000", None, None)
    with pytest.raises(Exception, match="not a UUID"):
        session.sql("SELECT CAST('550E8400' AS UUID) AS a").collect()
