"""Queries over the events table read as a log: as-of reads, a key-value store, queues, a stream and a ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from .catalogue import query



def _deleted():
    return F.col("event_type") == "error"


def _log(t):
    return t.events.select("event_id", "user_id", "event_type", "value")


@query("asof_snapshot", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_id <= (SELECT MAX(event_id) // 2 FROM events)) WHERE r = 1 AND event_type <> 'error'")
def asof_snapshot(t):
    middle = t.events.agg(F.max("event_id")).first()[0] // 2
    return L.as_of(_log(t), "user_id", "event_id", middle, _deleted())


@query("kv_latest", "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_type <> 'error'")
def kv_latest(t):
    return L.kv_get(_log(t), "user_id", "value", "event_id", _deleted())


@query("kv_previous", "SELECT event_id, user_id, LAG(CASE WHEN event_type <> 'error' THEN value END) OVER w AS previous, COALESCE(LAG(event_type <> 'error') OVER w, FALSE) AS existed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def kv_previous(t):
    return L.kv_history(_log(t), "user_id", "value", "event_id", _deleted()).select("event_id", "user_id", "previous", "existed")


def _queue(t):
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "ENQUEUE").when(kind == "click", "DEQUEUE").when(kind == "signup", "CLEAR")
    return t.events.select("event_id", (F.col("user_id") % 8).alias("q"), op.alias("op")).where("op IS NOT NULL AND (op <> 'CLEAR' OR event_id % 5 = 0)")


SQL_QUEUE = "(SELECT event_id, user_id % 8 AS q, CASE event_type WHEN 'purchase' THEN 'ENQUEUE' WHEN 'click' THEN 'DEQUEUE' ELSE 'CLEAR' END AS op FROM events WHERE event_type IN ('purchase', 'click') OR (event_type = 'signup' AND event_id % 5 = 0))"
SQL_ERAS = f"""eras AS (SELECT *, SUM(CASE WHEN op = 'CLEAR' THEN 1 ELSE 0 END) OVER (PARTITION BY q ORDER BY event_id) AS era FROM {SQL_QUEUE}),
sums AS (SELECT *, SUM(CASE op WHEN 'ENQUEUE' THEN 1 WHEN 'DEQUEUE' THEN -1 ELSE 0 END) OVER (PARTITION BY q, era ORDER BY event_id) AS s FROM eras),
sizes AS (SELECT *, s - LEAST(0, MIN(s) OVER (PARTITION BY q, era ORDER BY event_id)) AS size FROM sums)"""


@query("queue_fifo", f"""WITH {SQL_ERAS},
befores AS (SELECT *, COALESCE(LAG(size) OVER (PARTITION BY q, era ORDER BY event_id), 0) AS before FROM sizes),
puts AS (SELECT q, era, event_id, row_number() OVER (PARTITION BY q, era ORDER BY event_id) AS k FROM befores WHERE op = 'ENQUEUE'),
takes AS (SELECT q, era, event_id, row_number() OVER (PARTITION BY q, era ORDER BY event_id) AS k FROM befores WHERE op = 'DEQUEUE' AND before > 0)
SELECT q, takes.event_id AS dequeue_seq, puts.event_id AS enqueue_seq FROM takes JOIN puts USING (q, era, k)""")
def queue_fifo(t):
    return L.queue_matches(_queue(t), "event_id", "op", ["q"])


@query("queue_size", f"WITH {SQL_ERAS} SELECT event_id, q, CAST(size AS BIGINT) AS size FROM sizes")
def queue_size(t):
    return L.queue_size(_queue(t), "event_id", "op", ["q"]).select("event_id", "q", "size")


def _stream(t):
    return L.stream_positions(_log(t), "event_id", ~_deleted())


SQL_STREAM = "(SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS position FROM events WHERE event_type <> 'error')"


@query("stream_positions", f"SELECT event_id, position FROM {SQL_STREAM}")
def stream_positions(t):
    return _stream(t).select("event_id", "position")


@query("stream_read_from", f"SELECT position, value FROM {SQL_STREAM} WHERE position >= 100 ORDER BY position LIMIT 20")
def stream_read_from(t):
    return L.stream_read(_stream(t), 100, 20).select("position", "value")


@query("stream_latest", "SELECT COUNT(*) AS latest FROM events WHERE event_type <> 'error'")
def stream_latest(t):
    return L.stream_latest(_stream(t))


def _ledger(t):
    kind = F.col("event_type")
    op = F.when(kind == "signup", "MINT").when(kind == "purchase", "BURN").when(kind == "click", "TRANSFER")
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = t.events.select("event_id", op.alias("op"), cents.alias("amount"), F.col("user_id").alias("account"), ((F.col("user_id") * 7 + 1) % 150).alias("other"))
    return L.ledger(rows.where("op IS NOT NULL"), "op", "amount", "account", "other")


SQL_CENTS = "CAST(round(value * 100) AS BIGINT)"
SQL_LEDGER = f"""(SELECT event_id, user_id AS account, CASE event_type WHEN 'signup' THEN {SQL_CENTS} ELSE -{SQL_CENTS} END AS delta FROM events WHERE event_type IN ('signup', 'purchase', 'click')
UNION ALL SELECT event_id, (user_id * 7 + 1) % 150, {SQL_CENTS} FROM events WHERE event_type = 'click')"""


@query("ledger_balances", f"SELECT account, CAST(SUM(delta) AS BIGINT) AS balance FROM {SQL_LEDGER} GROUP BY account")
def ledger_balances(t):
    return L.balances(_ledger(t))


@query("ledger_supply", f"SELECT CAST(SUM(delta) AS BIGINT) AS supply FROM {SQL_LEDGER}")
def ledger_supply(t):
    return L.supply(_ledger(t))


@query("ledger_running", f"SELECT account, event_id, CAST(SUM(delta) OVER (PARTITION BY account ORDER BY event_id, delta ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM {SQL_LEDGER}")
def ledger_running(t):
    # A transfer to oneself gives an event two entries: its debit comes first.
    entries = _ledger(t).withColumn("at", F.col("event_id") * 2 + (F.col("delta") > 0).cast("int"))
    return L.running_balance(entries, "at").select(F.col("ledger_account").alias("account"), "event_id", "balance")


@query("resource_accept", f"""WITH RECURSIVE ops AS (SELECT user_id AS account, event_id, CASE event_type WHEN 'signup' THEN {SQL_CENTS} ELSE -{SQL_CENTS} END AS delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type IN ('signup', 'purchase')),
f AS (SELECT account, event_id, r, delta >= 0 AS accepted, CASE WHEN delta >= 0 THEN delta ELSE 0 END AS balance FROM ops WHERE r = 1
UNION ALL SELECT o.account, o.event_id, o.r, f.balance + o.delta >= 0, CASE WHEN f.balance + o.delta >= 0 THEN f.balance + o.delta ELSE f.balance END FROM f JOIN ops o ON o.account = f.account AND o.r = f.r + 1)
SELECT account, event_id, accepted, CAST(balance AS BIGINT) AS balance FROM f""")
def resource_accept(t):
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    rows = t.events.where(kind.isin("signup", "purchase")).select(F.col("user_id").alias("account"), "event_id", F.when(kind == "signup", cents).otherwise(-cents).alias("delta"))
    return L.accept(rows, "event_id", "account", "delta").select("account", "event_id", "accepted", "balance")


@query("own_writes", """SELECT user_id, value FROM (SELECT user_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM (
SELECT user_id, value, event_type, event_id FROM events UNION ALL SELECT user_id, value + 1, event_type, event_id + (SELECT MAX(event_id) FROM events) FROM events WHERE event_type = 'purchase')) WHERE r = 1 AND event_type <> 'error'""")
def own_writes(t):
    log, last = _log(t), t.events.agg(F.max("event_id")).first()[0]
    own = log.where("event_type = 'purchase'").withColumn("value", F.col("value") + 1).withColumn("event_id", F.col("event_id") + last)
    return L.kv_get(L.with_own_writes(log, own), "user_id", "value", "event_id", _deleted())


@query("resource_transfer", f"""WITH RECURSIVE ops AS (SELECT event_id, user_id % 10 AS resource, CAST(user_id % 150 // 10 + 1 AS INTEGER) AS one, CAST(event_id % 15 + 1 AS INTEGER) AS other, event_type AS kind, {SQL_CENTS} AS n,
row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) AS r FROM events WHERE event_type IN ('signup', 'purchase', 'click')),
f AS (SELECT DISTINCT resource, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS event_id, FALSE AS accepted, 1 AS one, [CAST(0 AS BIGINT) FOR i IN range(15)] AS held FROM ops
UNION ALL SELECT o.resource, o.r, o.event_id, o.kind = 'signup' OR held[o.one] >= n, o.one,
CASE WHEN o.kind = 'signup' OR held[o.one] >= n THEN [held[i] + CASE WHEN i = o.one THEN CASE WHEN o.kind = 'signup' THEN n ELSE -n END ELSE 0 END + CASE WHEN o.kind = 'click' AND i = o.other THEN n ELSE 0 END FOR i IN range(1, 16)] ELSE held END
FROM f JOIN ops o ON o.resource = f.resource AND o.r = f.r + 1)
SELECT event_id, accepted, CAST(held[one] AS BIGINT) AS balance FROM f WHERE r > 0""")
def resource_transfer(t):
    kind, user = F.col("event_type"), F.col("user_id")
    op = F.when(kind == "signup", "MINT").when(kind == "purchase", "BURN").when(kind == "click", "TRANSFER")
    account = lambda slot: F.concat_ws("/", user % 10, slot)
    rows = t.events.select("event_id", (user % 10).alias("resource"), op.alias("op"), F.round(F.col("value") * 100).cast("bigint").alias("amount"), account(F.floor(user % 150 / 10)).alias("account"), account(F.col("event_id") % 15).alias("other"))
    return L.accept_transfers(rows.where("op IS NOT NULL"), "event_id", "resource", "op", "amount", "account", "other").select("event_id", "accepted", "balance")


@query("queue_peek", f"""WITH {SQL_ERAS},
befores AS (SELECT *, COALESCE(LAG(size) OVER (PARTITION BY q, era ORDER BY event_id), 0) AS before, MAX(era) OVER (PARTITION BY q) AS last_era FROM sizes),
taken AS (SELECT q, COUNT(*) AS n FROM befores WHERE op = 'DEQUEUE' AND before > 0 AND era = last_era GROUP BY q),
puts AS (SELECT q, event_id, row_number() OVER (PARTITION BY q ORDER BY event_id) AS k FROM befores WHERE op = 'ENQUEUE' AND era = last_era)
SELECT q, MIN(event_id) AS head, COUNT(*) AS live FROM puts LEFT JOIN taken USING (q) WHERE k > COALESCE(n, 0) GROUP BY q""")
def queue_peek(t):
    log = _queue(t)
    cleared = log.where("op = 'CLEAR'").groupBy("q").agg(F.max("event_id").alias("cleared"))
    taken = L.queue_matches(log, "event_id", "op", ["q"]).select("q", F.col("enqueue_seq").alias("event_id"))
    live = log.where("op = 'ENQUEUE'").join(taken, ["q", "event_id"], "left_anti").join(cleared, "q", "left").where("cleared IS NULL OR event_id > cleared")
    return live.groupBy("q").agg(F.min("event_id").alias("head"), F.count("*").alias("live"))


@query("resource_metadata", "SELECT user_id % 10 AS resource, arg_max(event_type, event_id) AS name, arg_max(value, event_id) FILTER (WHERE event_type = 'signup') AS last_signup FROM events GROUP BY 1")
def resource_metadata(t):
    signup = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return t.events.groupBy((F.col("user_id") % 10).alias("resource")).agg(F.max_by("event_type", "event_id").alias("name"), F.max_by("value", signup).alias("last_signup"))


@query("resource_reservations", f"""WITH pending AS (SELECT user_id AS account, event_id, -{SQL_CENTS} AS amount FROM events WHERE event_type = 'purchase'),
balances AS (SELECT user_id AS account, SUM({SQL_CENTS}) AS balance FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT account, event_id, COALESCE(balance, 0) >= SUM(-amount) OVER (PARTITION BY account ORDER BY event_id) AS granted FROM pending LEFT JOIN balances USING (account)""")
def resource_reservations(t):
    cents = F.round(F.col("value") * 100).cast("bigint")
    pending = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("account"), "event_id", (-cents).alias("amount"))
    balance = t.events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("account")).agg(F.sum(cents).alias("balance"))
    return L.reservations(pending, balance, "event_id", "account", "amount").select("account", "event_id", "granted")
