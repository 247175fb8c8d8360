"""Operators and functions on small tables, against expectations worked out by hand or by brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberfold import types as T
from emberfold.functions import collections as C
from emberfold.functions import datetimes as D
from emberfold.functions import nulls as N
from emberfold.functions import numbers as M
from emberfold.functions import predicates as P
from emberfold.functions import strings as S
from emberfold.operators import aggregates as A
from emberfold.operators import dml as W
from emberfold.operators import logs as L
from emberfold.operators import relational as R
from emberfold.sources import tables
from emberfold.streaming.replay import replay, windowed_counts

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


@pytest.mark.parametrize("pattern, text, hit", [("a%", "abc", True), ("a_c", "abc", True), ("a_c", "a\nc", False), (r"a\%", "a%", True), (r"a\%", "ab", False), ("%.%", "a.b", True), ("%.%", "ab", False), ("", "", True)])
def test_like(spark, pattern, text, hit):
    assert value(spark, P.like(F.lit(text), pattern)) is hit


def test_predicates_with_null_and_nan(spark):
    nan, null = F.lit(float("nan")), F.lit(None).cast("int")
    assert value(spark, P.equal_number(nan, nan)) is False
    assert value(spark, P.between(F.lit(5), 9, null)) is None
    assert value(spark, P.in_list(F.lit(5), [1, None])) is None
    assert value(spark, P.xor(F.lit(True), null.cast("boolean"))) is None
    assert value(spark, P.ilike(F.lit("ÄB"), "äb")) is True


def test_numbers(spark):
    assert value(spark, M.int_div(F.lit(9007199254740993), 1)) == 9007199254740993
    assert value(spark, M.factorial(F.lit(20))) == 2432902008176640000
    assert value(spark, M.factorial(F.lit(33), wide=True)) == 8683317618811886495518194401280000000
    assert value(spark, M.round_(F.lit(2.5))) == 3.0
    assert value(spark, M.exponentiate(F.lit(3), 4)) == 81
    assert value(spark, M.unsigned(F.lit(255), 8)) == 255
    for bad in (M.unsigned(F.lit(256), 8), M.unsigned(F.lit(-1), 8), M.factorial(F.lit(21)), M.sqrt(F.lit(-1.0)), M.shift_left(F.lit(1), 64), M.exponentiate(F.lit(0), -1)):
        with pytest.raises(Exception):  # noqa: B017
            value(spark, bad)


def test_null_functions(spark):
    assert value(spark, N.greatest(1, 3, 2, kind="int")) == 3
    with pytest.raises(Exception):  # noqa: B017
        value(spark, N.least(1, F.lit(None).cast("int"), kind="int"))


def test_strings(spark):
    assert value(spark, S.trim(F.lit("  x\t"))) == "x"
    assert value(spark, S.find_idx(F.lit("banana"), "an", 3)) == 4
    assert value(spark, S.concat(F.lit(None).cast("string"), "b")) is None


@FEW
@given(st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=6), st.integers(-8, 8), st.integers(-8, 8))
def test_slice_is_pythons(spark, xs, a, b):
    got = value(spark, C.slice_(F.lit(xs).cast("array<int>") if xs else F.array().cast("array<int>"), a, b))
    assert got == xs[max(a, -len(xs)) if a < 0 else a : b if b >= -len(xs) else 0]


def test_intervals():
    assert D.parse_interval("1-3", "YEAR TO MONTH") == (15, 0, 0)
    assert D.parse_interval("-2 03:04:05.5", "DAY TO SECOND") == (0, -2, -11045500000)
    assert D.parse_interval("1:30", "HOUR TO MINUTE") == (0, 0, 5_400_000_000)
    assert D.spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_types(spark):
    assert T.spark_type("MAP(VARCHAR, INT[])").simpleString() == "map<string,array<int>>"
    assert T.spark_type("STRUCT(a INT, b MAP(VARCHAR, DOUBLE))").simpleString() == "struct<a:int,b:map<string,double>>"
    assert value(spark, T.cast(F.lit("550E8400E29B41D4A716446655440000"), "UUID")) == "550e8400-e29b-41d4-a716-446655440000"
    with pytest.raises(Exception):  # noqa: B017
        value(spark, T.cast(F.lit("no"), "UUID"))


def test_aggregates_keep_nulls(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (1, None)], "k int, v int")
    assert sorted(df.agg(A.array_agg("v")).first()[0], key=str) == [2, None, None]
    assert df.agg(A.count_distinct_rows(df)).first()[0] == 2


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    empty, some, nulls = (spark.createDataFrame(r, "y int") for r in ([], [(1,)], [(1,), (None,)]))
    assert R.not_in(left, empty, "x", "y").count() == 3
    assert [r[0] for r in R.not_in(left, some, "x", "y").collect()] == [2]
    assert R.not_in(left, nulls, "x", "y").count() == 0


def test_tables(spark):
    assert tables.series(spark, 0).count() == 0
    with pytest.raises(ValueError):
        tables.series(spark, -1)
    assert tables.values(spark, [(1, "a")]).columns == ["column1", "column2"]
    with pytest.raises(ValueError):
        R.limit_offset(spark.range(3), -1)


def test_delete_actions(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(10, 1), (11, 2)], "id int, parent int")
    grand = spark.createDataFrame([(100, 10)], "id int, child int")
    tables_ = {"parent": parent, "child": child, "grand": grand}
    cascade = [W.ForeignKey("child", "parent", "parent", "id", "CASCADE"), W.ForeignKey("grand", "child", "child", "id", "SET NULL")]
    out = W.delete_with_keys(tables_, "parent", F.col("id") == 1, cascade)
    assert [r[0] for r in out["parent"].collect()] == [2]
    assert [tuple(r) for r in out["child"].collect()] == [(11, 2)]
    assert [tuple(r) for r in out["grand"].collect()] == [(100, None)]
    with pytest.raises(W.ConstraintError):
        W.delete_with_keys(tables_, "parent", F.col("id") == 1, [W.ForeignKey("child", "parent", "parent", "id", "RESTRICT")])


def test_migrations_run_once():
    done, m = [], W.Migrations()
    assert m.migrate(1, lambda: done.append(1)) and not m.migrate(1, lambda: done.append(1)) and m.migrate(2, lambda: done.append(2))
    assert done == [1, 2]


@FEW
@given(st.lists(st.sampled_from(["ENQUEUE", "DEQUEUE", "DEQUEUE", "CLEAR"]), min_size=1, max_size=30))
def test_queue_is_first_in_first_out(spark, ops):
    live, takes, sizes = [], [], []
    for i, op in enumerate(ops):
        if op == "ENQUEUE":
            live.append(i)
        elif op == "CLEAR":
            live.clear()
        elif live:
            takes.append((i, live.pop(0)))
        sizes.append((i, len(live)))
    log = spark.createDataFrame(list(enumerate(ops)), "seq long, op string")
    assert sorted(map(tuple, L.queue_matches(log, "seq", "op").collect())) == takes
    assert sorted((r["seq"], r["size"]) for r in L.queue_size(log, "seq", "op").collect()) == sizes


def test_stream_positions_are_dense(spark):
    rng = random.Random(1)
    rows = [(i * 3, rng.random() < 0.8) for i in range(500)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "seq long, ok boolean")
    got = {r["seq"]: r["position"] for r in L.stream_positions(log, "seq", F.col("ok")).collect()}
    assert got == {s: p for p, s in enumerate(sorted(s for s, ok in rows if ok), 1)}
    assert L.stream_latest(L.stream_positions(log.where("false"), "seq", F.col("ok"))).first()[0] == 0


def test_ledger_conserves_and_accepts(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["MINT", "BURN", "TRANSFER"]), rng.randrange(50), rng.randrange(4), rng.randrange(4)) for i in range(300)]
    entries = L.ledger(spark.createDataFrame(rows, "seq long, op string, amount long, a long, b long"), "op", "amount", "a", "b")
    balances = {r["account"]: r["balance"] for r in L.balances(entries).collect()}
    assert sum(balances.values()) == L.supply(entries).first()[0] == sum({"MINT": 1, "BURN": -1}.get(op, 0) * n for _, op, n, _, _ in rows)
    deltas = [(i, a, n if op == "MINT" else -n) for i, op, n, a, _ in rows]
    balance, want = {}, {}
    for i, a, d in deltas:
        ok = balance.get(a, 0) + d >= 0
        balance[a] = balance.get(a, 0) + (d if ok else 0)
        want[i] = (ok, balance[a])
    got = L.accept(spark.createDataFrame(deltas, "seq long, account long, delta long"), "seq", "account", "delta").collect()
    assert {r["seq"]: (r["accepted"], r["balance"]) for r in got} == want


def test_as_of_and_history(spark):
    log = spark.createDataFrame([("a", 1, 10, False), ("a", 2, None, True), ("a", 5, 30, False), ("b", 3, 40, False)], "k string, txn long, v long, gone boolean")
    at = lambda ts: sorted(map(tuple, L.as_of(log, "k", "txn", ts, F.col("gone")).select("k", "v").collect()))
    assert at(1) == [("a", 10)] and at(2) == [] and at(4) == [("b", 40)] and at(9) == [("a", 30), ("b", 40)]
    got = {r["txn"]: (r["previous"], r["existed"]) for r in L.kv_history(log, "k", "v", "txn", F.col("gone")).collect()}
    assert got == {1: (None, False), 2: (10, True), 5: (None, False), 3: (None, False)}


def test_replay_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(f"{source}/1")
    first = replay(spark, f"{source}/*", spark.range(1).schema, folder)
    assert first.count() == 5
    spark.range(5, 8).write.parquet(f"{source}/2")
    again = replay(spark, f"{source}/*", spark.range(1).schema, folder)
    assert sorted(r[0] for r in again.collect()) == list(range(8))


def test_windowed_counts(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) AS at, id % 2 AS k FROM range(120)")
    got = windowed_counts(rows, "at", "k").collect()
    assert sorted(r["n"] for r in got) == [30, 30, 30, 30]


def test_running_values_over_blocks(spark):
    from emberfold.operators.prefix import previous, running_sum

    rng = random.Random(3)
    rows = [(i, None if i % 11 == 0 else "hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(-3, 4)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "at long, k string, v long")
    got = {r["at"]: r for r in previous(running_sum(df, ["k"], "at", F.col("v"), "s", low="low", blocks=7), ["k"], "at", {"before": F.col("v")}, blocks=5).collect()}
    state = {}
    for at, k, v in sorted(rows):
        s, low, last = state.get(k, (0, 0, None))
        r = got[at]
        assert (r["s"], r["low"], r["low_before"], r["before"]) == (s + v, min(low, s + v), low, last)
        state[k] = (s + v, min(low, s + v), v)
    assert len(got) == len(rows)


def test_transfers_are_accepted_as_a_log(spark):
    rng, rows = random.Random(3), []
    for i in range(3000):  # one resource holds a third of all rows
        resource = "big" if i % 3 == 0 else f"r{rng.randrange(20)}"
        one, other = (f"{resource}/{rng.randrange(5)}" for _ in range(2))
        rows.append((i, resource, rng.choice(["MINT", "BURN", "TRANSFER"]), rng.choice([None, -1, *range(9)]) if i else 2**60 + 1, one, rng.choice([other, None])))
    held, want = {}, {}
    for i, resource, kind, n, one, other in rows:
        ok = n is not None and n >= 0 and (kind == "MINT" or held.get(one, 0) >= n) and (kind != "TRANSFER" or other is not None)
        if ok:
            held[one] = held.get(one, 0) + (n if kind == "MINT" else -n)
            if kind == "TRANSFER":
                held[other] = held.get(other, 0) + n
        want[i] = (ok, held.get(one, 0))
    df = spark.createDataFrame(rows, "at long, resource string, op string, amount long, account string, other string").repartition(5)
    got = {r["at"]: (r["accepted"], r["balance"]) for r in L.accept_transfers(df, "at", "resource", "op", "amount", "account", "other").collect()}
    assert got == want


def test_blocks_count_the_edges_before(spark):
    from emberfold.operators.prefix import _block

    edges = [float(x * x) for x in range(90)]
    got = spark.range(-5, 8200, 37).select("id", _block(F.col("id").cast("double"), edges).alias("b")).collect()
    assert all(r["b"] == sum(e < r["id"] for e in edges) for r in got)
