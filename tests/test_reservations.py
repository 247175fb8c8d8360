"""Reservations over debits of nothing, ties, nulls and negative values, against SQL."""

import random

import pytest
from compare import compare, duck
from pyspark.sql import functions as F

from emberfold.operators import logs as L
from emberfold.plans import catalogue

NAME = "resource_reservations"


def _compared(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    compare(catalogue.QUERIES[NAME](spark, str(folder)), duck(str(folder)), catalogue.ORACLE_SQL[NAME])


def test_a_debit_of_nothing_fails_once_more_is_asked_for_than_there_is(spark, tmp_path):
    _compared(spark, tmp_path, [(1, 0, "signup", 5.0), (2, 0, "purchase", 0.0), (3, 0, "purchase", 7.0), (4, 0, "purchase", 0.0), (5, 1, "purchase", 0.0)])


@pytest.mark.parametrize("odd", ["ties", "null_values", "null_places", "negative"])
def test_odd_rows_match_sql(spark, tmp_path, odd):
    rng = random.Random(4)
    rows = []
    for i in range(2000):
        at = i // 4 if odd == "ties" else None if odd == "null_places" and rng.random() < 0.1 else i
        value = None if odd == "null_values" and rng.random() < 0.4 else rng.choice([0.0, 0.01, 9.5, rng.randrange(900) / 100])
        rows.append((at, rng.choice([None, 0, 0, *range(60)]), rng.choice(["signup", "purchase", "purchase"]), -value if odd == "negative" and value and rng.random() < 0.3 else value))
    _compared(spark, tmp_path, rows)


def test_credits_never_conflict(spark):
    pending = spark.createDataFrame([(1, "a", -6, False), (2, "a", 50, True), (3, "a", -6, False), (4, "a", 0, True)], "at long, account string, amount long, gives boolean")
    balance = spark.createDataFrame([("a", 10)], "account string, balance long")
    got = L.reservations(pending, balance, "at", "account", "amount", F.col("gives")).select("at", "granted").collect()
    assert sorted(map(tuple, got)) == [(1, True), (2, True), (3, False), (4, True)]
