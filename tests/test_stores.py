"""The clients of the log-backed stores, and the session's calls."""

import pytest
from pyspark.sql import functions as F

from emberfold.session import Session
from emberfold.stores import KeyValueStore, Queue, Resource, Stream


def test_key_value(spark):
    kv = KeyValueStore(spark)
    assert kv.get("a") is None and kv.put("a", "1") is None and kv.put("a", "2") == "1"
    before = kv.txn
    assert kv.delete("a") is True and kv.delete("a") is False and kv.get("a") is None
    assert kv.get("a", before) == "2"
    again = KeyValueStore(spark, kv.log())
    again.put("b", "3")
    assert again.txn == kv.txn + 1
    again.abort()
    assert again.get("b") is None


def test_queue(spark):
    q = Queue(spark)
    assert q.dequeue() is None and q.is_empty()
    q.enqueue("a"), q.enqueue("b")
    assert q.peek() == "a" and q.size() == 2 and q.dequeue() == "a" and q.peek() == "b"
    q.clear()
    assert q.is_empty()
    q.enqueue("c")
    assert q.dequeue() == "c"


def test_stream(spark):
    s = Stream(spark)
    assert s.latest_position() == 0
    s.append("a")
    assert s.latest_position() == 0
    s.commit()
    s.append("lost"), s.abort()
    s.append("b"), s.commit()
    assert s.latest_position() == 2 and s.read_from(1, 10) == [(1, "a"), (2, "b")] and s.read_from(2, 1) == [(2, "b")]


def test_resource(spark):
    r = Resource(spark)
    r.initialize("Gold", "G", 2)
    with pytest.raises(ValueError):
        r.initialize("Gold", "G", 2)
    r.mint("x", 10), r.transfer("x", "y", 4), r.burn("y", 1)
    assert (r.get_balance("x"), r.get_balance("y"), r.get_balance("z"), r.get_total_supply()) == (6, 3, 0, 9)
    with pytest.raises(ValueError):
        r.burn("y", 4)
    r.update_metadata(symbol="AU")
    assert r.get_metadata() == ("Gold", "AU", 2)


def test_session_calls(spark):
    s = Session(spark)
    s.create_table("people", "id INTEGER PRIMARY KEY, name TEXT")
    s.insert("people", [(1, "a"), (2, "b")])
    s.update("people", "name = 'z'", "id = 2")
    s.delete("people", "id = 1")
    assert s.single_value(s.select("people", "name")) == "z" and s.column_values(s.select("people"), "id") == [2]
    assert s.count("people", "id > 1") == 1
    assert s.migrate(1, "INSERT INTO people VALUES (5, 'm')") and not s.migrate(1, "INSERT INTO people VALUES (6, 'n')")
    assert s.count("people") == 2
    s.drop_table("people")


def test_snapshot_reads(spark):
    s = Session(spark)
    log = spark.createDataFrame([(1, 100, "old", False), (1, 300, "new", False), (2, 200, "gone", True)], "id int, txn long, name string, dead boolean")
    at = lambda ts: [tuple(r) for r in s.read_at("SELECT id, name FROM people ORDER BY id", ts, {"people": (log, "id", "txn", F.col("dead"))}).collect()]
    assert at(250) == [(1, "old")] and at(300) == [(1, "new")] and at(50) == []


def test_more_of_the_dialect(spark):
    s = Session(spark)
    one = lambda q: tuple(s.sql(q).first())
    assert one("SELECT CAST('[1, 2]' AS INT[]) AS a, UNWRAP({'a': [1, 7]}, 'a.1') AS b") == ([1, 2], "7")
    ids = s.sql("SELECT GENERATE_UUID() AS id FROM SERIES(3)")
    assert ids.distinct().count() == 3 and sorted(ids.collect()) == sorted(ids.collect())
