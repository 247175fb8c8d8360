"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. A source's target is its weighted share of all words, capped at `MOST_COPIES` times its own size, with
the excess shared again by weight until no source is above its cap. Whole copies of a source are taken while they fit.
What is left of the target is a budget that some of the source's documents fill once more: documents are counted by
exact length, the budget is dealt in proportion to the counts, and a bounded knapsack over the lengths (a bitset of
reachable sums) finds counts that fill the remaining budget exactly. Where none do, dealt documents are given back,
`GIVEN_BACK` words or all of them, and the knapsack runs again. So a budget of up to `GIVEN_BACK` words is met as nearly
as any choice of documents can; a larger one is missed only if no choice that keeps the rest as dealt meets it.

Which documents of a length are taken is decided by a seeded hash of the document's key, so reruns agree. The result of
planning is a table with a row for each (source, length): copies for all, and the last (hash, row) that is taken once
more. Applying it is one join with that table, broadcast only when it is counted and small; texts are never shuffled
then. Ranks are taken inside (source, length, hash prefix), so a length that a third of all rows share is split.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own and comes last. Rows
with one key tie in the hash and are told apart by their place in the input, so a repeated row is taken as often as its
rank says. An empty table gives no rows. A source whose documents are all empty has target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, join_by_key, whole_text, written

WEIGHTS, MOST_COPIES, SEED = (5, 2, 1), 3, 20
#: The knapsack starts once no more than so many words of a budget are left, and gives back so many if it misses.
KNAPSACK_WORDS, GIVEN_BACK = 65_536, 1 << 20
#: Hash prefixes that split a (source, length).
PREFIX_BITS = 10
#: A plan of so many rows, 10 MB or so, is broadcast, so texts are not shuffled; of a longer one only the lengths that many
#: documents share are.
BROADCAST_ROWS = 200_000
BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: str | Column = "text") -> Column:
    trimmed = F.trim(whole_text(text), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def marked(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """Add the size, the source as a non-null name, the seeded hash and the row's place in the input."""
    return docs.withColumns(
        {
            "__ef_size": n_words(text),
            "__ef_source": F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")),
            "__ef_hash": F.xxhash64(F.lit(seed), F.col(key)),
            "__ef_row": F.monotonically_increasing_id(),
        }
    )


def targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """__ef_source, source_size, target. The windows run over one row for each source."""
    every = Window.partitionBy()
    # "=..." sorts before "null", and names sort by their bytes, which is code point order.
    by_name = Window.orderBy("__ef_source")
    sources = slim.groupBy("__ef_source").agg(F.sum("__ef_size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    sources = sources.withColumn("cap", most * F.col("source_size")).withColumn("all", F.sum("source_size").over(every))
    # Caps bind from the least cap per weight on; the water level is what the others share.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "__ef_source")
    sources = sources.withColumn("capped_before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sources = sources.withColumn("weight_from", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("all") - F.col("capped_before")) / F.col("weight_from")
    sources = sources.withColumn("free_level", F.when(level * F.col("weight") <= F.col("cap"), level))
    sources = sources.withColumn("level", F.max("free_level").over(every))
    return sources.select("__ef_source", "source_size", F.when(F.col("free_level").isNull(), F.col("cap").cast("double")).otherwise(F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0))).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, knapsack: int = KNAPSACK_WORDS, given_back: int = GIVEN_BACK) -> np.ndarray:
    """How many documents of each length make up the budget: exactly, or the most below it that the knapsack reaches."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    best, missed = None, budget + 1
    order = np.random.default_rng(seed).permutation(len(lengths))
    for window in (0, min(budget, knapsack), min(budget, given_back)):
        taken = _dealt(lengths, counts, budget - window, total)
        for i in order:
            left = budget - int((lengths * taken).sum())
            if left <= max(window, knapsack):
                break
            if length := int(lengths[i]):
                taken[i] += min(int(counts[i] - taken[i]), (left - max(window, knapsack)) // length)
        short = _filled(lengths, counts, taken, budget - int((lengths * taken).sum()), order)
        if short < missed:
            best, missed = taken, short
        if not missed:
            break
    return best


def _dealt(lengths: np.ndarray, counts: np.ndarray, words: int, total: int) -> np.ndarray:
    return np.array([int(c) * words // total for c in counts], dtype=np.int64)


def _filled(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, left: int, order: np.ndarray) -> int:
    """Add to `taken` what comes nearest below so many words; how many stay missing.

    Each sum keeps the step that first reached it, so the way back needs no bitset of every step.
    """
    reach, full, steps, first = 1, (1 << (left + 1)) - 1, [], np.full(left + 1, -1, dtype=np.int32)
    for i in order:
        length, free, size = int(lengths[i]), int(counts[i] - taken[i]), 1
        while length and free and not reach >> left & 1:
            some = min(size, free)
            if some * length <= left:
                new = (reach << some * length & full) & ~reach
                if new:
                    bits = np.frombuffer(new.to_bytes(left // 8 + 1, "little"), dtype=np.uint8)
                    first[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(steps)
                    steps.append((i, some))
                    reach |= new
            free, size = free - some, size * 2
    at = best = reach.bit_length() - 1
    while at:
        i, some = steps[first[at]]
        taken[i] += some
        at -= some * int(lengths[i])
    return left - best


def _choose(source: pd.DataFrame) -> pd.DataFrame:
    one = source.sort_values("__ef_size", kind="stable")
    size, target = int(one["source_size"].iloc[0]), float(one["target"].iloc[0])
    copies = int(target // size) if size else 0
    lengths, counts = one["__ef_size"].to_numpy(np.int64), one["docs"].to_numpy(np.int64)
    extra = fit(lengths, counts, round(target - copies * size))
    return pd.DataFrame({"__ef_source": one["__ef_source"], "__ef_size": lengths, "docs": counts, "copies": copies, "extra": extra})


def plan(slim: DataFrame, wanted: DataFrame) -> DataFrame:
    """__ef_source, __ef_size, docs, copies, last_hash, last_row: what to take of each (source, length)."""
    key = ["__ef_source", "__ef_size"]
    slim = slim.select(*key, "__ef_hash", "__ef_row", F.shiftright("__ef_hash", 64 - PREFIX_BITS).alias("prefix"))
    prefixes = cut(slim.groupBy(*key, "prefix").agg(F.count("*").alias("docs")))
    lengths = prefixes.groupBy(*key).agg(F.sum("docs").alias("docs")).join(wanted, "__ef_source")
    # A group here is one source's counts by length: it grows with the number of distinct lengths, not of documents.
    chosen = cut(lengths.groupBy("__ef_source").applyInPandas(_choose, "__ef_source string, __ef_size long, docs long, copies int, extra long"))
    some = chosen.where((F.col("extra") > 0) & (F.col("extra") < F.col("docs"))).select(*key, "extra")
    running = Window.partitionBy(*key).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** PREFIX_BITS rows at most
    edge = prefixes.withColumn("before", F.coalesce(F.sum("docs").over(running), F.lit(0))).join(some, key)
    edge = edge.where((F.col("before") < F.col("extra")) & (F.col("extra") <= F.col("before") + F.col("docs"))).select(*key, "prefix", (F.col("extra") - F.col("before")).alias("rank"))
    ranked = slim.join(edge, [*key, "prefix"]).withColumn("at", F.row_number().over(Window.partitionBy(*key, "prefix").orderBy("__ef_hash", "__ef_row")))
    last = ranked.where(F.col("at") == F.col("rank")).select(*key, F.col("__ef_hash").alias("last_hash"), F.col("__ef_row").alias("last_row"))
    none, every = (1 << 63) - 1, F.col("extra") == F.col("docs")
    out = chosen.join(last, key, "left").select(
        *key,
        "docs",
        (F.col("copies") + F.when(every & (F.col("extra") > 0), 1).otherwise(0)).alias("copies"),
        F.coalesce("last_hash", F.lit(-none - 1)).alias("last_hash"),
        F.coalesce("last_row", F.lit(-1)).alias("last_row"),
    )
    return out


def apply_plan(docs: DataFrame, plan_rows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs: as `marked` leaves them. Adds __ef_copies, how often each document is taken."""
    plan_rows, key = cut(plan_rows), ["__ef_source", "__ef_size"]
    lengths, total = plan_rows.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0))).first()
    if lengths <= broadcast_rows:
        joined = docs.join(F.broadcast(plan_rows.drop("docs")), key)
    else:
        joined = join_by_key(docs, plan_rows, key, total, "docs")
    once_more = (F.col("__ef_hash") < F.col("last_hash")) | ((F.col("__ef_hash") == F.col("last_hash")) & (F.col("__ef_row") <= F.col("last_row")))
    copies = F.when(F.col("__ef_size") > 0, F.col("copies") + once_more.cast("int")).otherwise(0)
    return joined.withColumn("__ef_copies", copies).drop("copies", "last_hash", "last_row")


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of `docs`."""
    all_docs = written(marked(docs, key, source, text, seed), "marked")  # a row's place stays what it is
    slim = cut(all_docs.select("__ef_source", "__ef_size", "__ef_hash", "__ef_row"))
    taken = apply_plan(all_docs, plan(slim, targets(slim))).where(F.col("__ef_copies") > 0)
    return taken.withColumn("__ef_copy", F.explode(F.sequence(F.lit(1), F.col("__ef_copies")))).select(*docs.columns)
