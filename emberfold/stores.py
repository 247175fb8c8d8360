"""Clients of the log-backed stores: key-value, queue, stream and resource.

A store is a log of operations, each with its transaction number. Writing appends; reading folds the log with the
operators of emberfold.operators.logs, as of any transaction. A log that is on disk is given as a DataFrame; operations
of this client are pending rows beside it until `log()` is written by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import logs as L


class Store:
    """Pending operations over a committed log of the schema COLUMNS."""

    COLUMNS = "txn long, op string"

    def __init__(self, spark: SparkSession, committed: DataFrame | None = None):
        self.spark, self.committed, self.pending = spark, committed, []
        self.txn = 0 if committed is None else committed.agg(F.coalesce(F.max("txn"), F.lit(0))).first()[0]

    def _append(self, *row) -> int:
        self.txn += 1
        self.pending.append((self.txn, *row))
        return self.txn

    def log(self, timestamp: int | None = None) -> DataFrame:
        """All operations up to a transaction, own ones included."""
        own = self.spark.createDataFrame(self.pending, self.COLUMNS)
        rows = own if self.committed is None else L.with_own_writes(self.committed, own)
        return rows if timestamp is None else rows.where(F.col("txn") <= timestamp)

    def abort(self) -> None:
        """Drop what is pending. Numbers are not used again."""
        self.pending = []


class KeyValueStore(Store):
    COLUMNS = "txn long, op string, key string, value string"

    def state(self, timestamp: int | None = None) -> DataFrame:
        return L.kv_get(self.log(timestamp), "key", "value", "txn", F.col("op") == "DELETE")

    def get(self, key: str, timestamp: int | None = None) -> str | None:
        row = self.state(timestamp).where(F.col("key") == key).first()
        return row["value"] if row else None

    def put(self, key: str, value: str) -> str | None:
        """The value before."""
        before = self.get(key)
        self._append("PUT", key, value)
        return before

    def delete(self, key: str) -> bool:
        """Whether the key was there."""
        there = not self.state().where(F.col("key") == key).isEmpty()
        self._append("DELETE", key, None)
        return there


class Queue(Store):
    COLUMNS = "txn long, op string, value string"

    def live(self, timestamp: int | None = None) -> DataFrame:
        """Items not yet taken, with their sequence numbers."""
        log = self.log(timestamp)
        cleared = log.where("op = 'CLEAR'").agg(F.coalesce(F.max("txn"), F.lit(0)).alias("cleared"))
        taken = L.queue_matches(log, "txn", "op").select(F.col("enqueue_seq").alias("txn"))
        items = log.where("op = 'ENQUEUE'").join(taken, "txn", "left_anti")
        return items.join(F.broadcast(cleared), F.col("txn") > F.col("cleared")).select(F.col("txn").alias("seq"), "value")

    def enqueue(self, value: str) -> int:
        return self._append("ENQUEUE", value)

    def dequeue(self) -> str | None:
        value = self.peek()
        self._append("DEQUEUE", None)
        return value

    def peek(self) -> str | None:
        row = self.live().orderBy("seq").limit(1).first()
        return row["value"] if row else None

    def size(self) -> int:
        return self.live().count()

    def is_empty(self) -> bool:
        return self.live().isEmpty()

    def clear(self) -> None:
        self._append("CLEAR", None)


class Stream(Store):
    COLUMNS = "txn long, op string, value string"

    def append(self, value: str) -> None:
        """Visible, at a position, once committed."""
        self._append("APPEND", value)

    def commit(self) -> None:
        """The pending values take the next positions."""
        self.committed, self.pending = self.log(), []

    def positions(self) -> DataFrame:
        rows = self.spark.createDataFrame([], self.COLUMNS) if self.committed is None else self.committed
        return L.stream_positions(rows, "txn", F.lit(True)).select("position", "value")

    def read_from(self, position: int, limit: int) -> list[tuple[int, str]]:
        return [tuple(r) for r in L.stream_read(self.positions(), position, limit).collect()]

    def latest_position(self) -> int:
        return L.stream_latest(self.positions()).first()[0]


class Resource(Store):
    """Balances of one fungible resource, in whole units."""

    COLUMNS = "txn long, op string, account string, other string, amount long, name string, symbol string, decimals int"

    def _entries(self) -> DataFrame:
        return L.ledger(self.log().where("op IN ('MINT', 'BURN', 'TRANSFER')"), "op", "amount", "account", "other")

    def initialize(self, name: str, symbol: str, decimals: int) -> None:
        if not self.log().where("op = 'INITIALIZE'").isEmpty():
            raise ValueError("the resource is initialized already")
        self._append("INITIALIZE", None, None, None, name, symbol, decimals)

    def update_metadata(self, name: str | None = None, symbol: str | None = None) -> None:
        self._append("METADATA", None, None, None, name, symbol, None)

    def get_metadata(self) -> tuple:
        """Each part's last value."""
        rows = self.log().where("op IN ('INITIALIZE', 'METADATA')")
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("txn"))).alias(c)
        return tuple(rows.agg(last("name"), last("symbol"), last("decimals")).first())

    def mint(self, account: str, amount: int) -> None:
        self._append("MINT", account, None, _amount(amount), None, None, None)

    def burn(self, account: str, amount: int) -> None:
        self._covered(account, amount)
        self._append("BURN", account, None, _amount(amount), None, None, None)

    def transfer(self, account: str, other: str, amount: int) -> None:
        self._covered(account, amount)
        self._append("TRANSFER", account, other, _amount(amount), None, None, None)

    def _covered(self, account: str, amount: int) -> None:
        if self.get_balance(account) < amount:
            raise ValueError(f"{account} has less than {amount}")

    def get_balance(self, account: str) -> int:
        row = L.balances(self._entries().where(F.col("ledger_account") == account)).first()
        return row["balance"] if row else 0

    def get_total_supply(self) -> int:
        return L.supply(self._entries()).first()[0]


def _amount(n: int) -> int:
    if n < 0:
        raise ValueError("an amount is 0 or more")
    return n
