"""SimHash near-duplicates through pivot distance tables.

A fingerprint has a bit for each bit that more than half of the document's shingle hashes set. Documents link when their
fingerprints differ in `MOST_BITS` bits at most. Equal fingerprints are folded first, so everything after works on
distinct fingerprints, whatever a group of copies holds.

Two fingerprints that differ in at most two bits agree on at least two of four 16-bit blocks, so each fingerprint is
filed under its six pairs of blocks: no linked pair is missed. The Hamming distances of every fingerprint to many fixed
reference fingerprints, the pivots, are precomputed once and go with it. By the triangle inequality the distances of a
linked pair differ by at most `MOST_BITS` at every pivot, so inside a file a pair whose greatest coordinate difference
is more is discarded without being compared; survivors are verified bit by bit. A file gives a star for each of its
linked groups, not its pairs.

A file with more than `FILE_ROWS` fingerprints is not compared pairwise. Its fingerprints are linked exactly through the
values within one bit of them (65 each): two fingerprints share such a value just when they differ in two bits at most,
and no value has more than 65 of them. Files are counted before they are dealt out, so such a file never meets in a task.

Components come from alternating large-star and small-star steps over the links, each written to the shared folder;
adaptive execution splits hubs. Fingerprints of many members are joined apart, so that none meets in one task.

Defined results: a null or empty text has fingerprint 0 and links like any other. Rows of one doc_id are members like any
others. A null doc_id is the smallest, so it is the component_id of all that it links to. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key, whole_text, written

WORDS, SEED, MOST_BITS = 3, 42, 2
BLOCK_BITS = 16
PIVOTS = np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 0) for i in range(24)], dtype=np.uint64)
FILE_ROWS = 2048
#: Links for each task of a round.
TASK_ROWS = 200_000


def fingerprint_of(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """bytes.lower and bytes.split touch A-Z and the six white-space bytes only, as the contract has it."""
    found = text.encode().lower().split()
    if not found:
        return 0
    tails = [found[k:] for k in range(words)] if len(found) >= words else [[b" ".join(found)]]
    digest, ones, n, some = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64), 0, []
    for shingle in zip(*tails):
        some.append(digest(b" ".join(shingle), seed))
        if len(some) == 65_536:
            ones, n, some = ones + _ones(some), n + len(some), []
    ones, n = ones + _ones(some), n + len(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _ones(digests: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(t.as_py()) for t in texts], pa.int64())


def fingerprint(text: str | Column = "text") -> Column:
    """The fingerprint's 64 bits as a signed long."""
    return F.arrow_udf(_fingerprints, "long")(whole_text(text))


def hex_of(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def pivot_distances(bits: Column) -> Column:
    """A byte for each pivot."""
    return F.concat(*(F.unhex(F.lpad(F.hex(F.bit_count(bits.bitwiseXOR(F.lit(int(p.astype(np.int64)))))), 2, "0")) for p in PIVOTS))


def _filed(prints: DataFrame) -> DataFrame:
    """prints: bits. A row for each pair of blocks."""
    blocks = 64 // BLOCK_BITS
    masks = [sum(((1 << BLOCK_BITS) - 1) << BLOCK_BITS * b for b in pair) for pair in combinations(range(blocks), blocks - MOST_BITS)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    files = F.array(*(F.struct(F.lit(i).alias("pair"), F.col("bits").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)))
    return prints.withColumn("file", F.explode(files)).select("file.pair", "file.part", "bits", "distances")


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by file, and a file is whole within the partition."""
    kept = None
    for batch in batches:
        now = (batch["pair"].to_numpy(), batch["part"].to_numpy(), batch["bits"].to_numpy(), np.frombuffer(b"".join(batch["distances"].to_pylist()), dtype=np.uint8).reshape(-1, len(PIVOTS)))
        if kept is not None:
            now = tuple(np.concatenate(x) for x in zip(kept, now))
        if not len(now[0]):
            continue
        open_from = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1])).max(initial=-1)) + 1
        kept = tuple(x[open_from:].copy() for x in now)  # the last file may go on in the next batch
        if open_from:
            yield _links_of(*(x[:open_from] for x in now))
    if kept is not None:
        yield _links_of(*kept)


def _links_of(pair: np.ndarray, part: np.ndarray, bits: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    parent = np.arange(len(bits))
    low = distances.astype(np.int16)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    at, step = np.arange(len(bits) - 1), 1
    while len(at := at[at + step < len(bits)]):
        at = at[(pair[at] == pair[at + step]) & (part[at] == part[at + step])]
        near = at[np.abs(low[at] - low[at + step]).max(axis=1, initial=0) <= MOST_BITS] if len(at) else at
        sure = near[np.bitwise_count((bits[near] ^ bits[near + step]).view(np.uint64)) <= MOST_BITS]
        for i in sure[parent[sure] != parent[sure + step]]:
            a, b = root(int(i)), root(int(i + step))
            parent[max(a, b)] = min(a, b)
        step += 1
    roots = np.array([root(i) for i in np.flatnonzero(parent != np.arange(len(bits)))], dtype=np.int64)
    of = np.flatnonzero(parent != np.arange(len(bits)))
    return pa.RecordBatch.from_arrays([pa.array(bits[of]), pa.array(bits[roots])], ["a", "b"])


def links(prints: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """prints: distinct bits. Rows (a, b) whose components are those of all pairs within MOST_BITS."""
    filed = _filed(prints.withColumn("distances", pivot_distances(F.col("bits"))))
    crowded = cut(filed.groupBy("pair", "part").agg(F.count("*").alias("n")).where(F.col("n") > file_rows).select("pair", "part"))
    alone = filed.join(crowded, ["pair", "part"], "left_anti").repartition("pair", "part").sortWithinPartitions("pair", "part")
    found = alone.mapInArrow(_linked, "a long, b long")
    flips = [F.col("bits").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)]
    members = filed.join(crowded, ["pair", "part"], "left_semi").select("bits").distinct()
    shared = members.select("bits", F.explode(F.array(F.col("bits"), *flips)).alias("value"))
    stars = shared.groupBy("value").agg(F.min("bits").alias("b"), F.collect_set("bits").alias("all")).select(F.explode("all").alias("a"), "b").where("a != b")
    return found.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with a link; root is the component's smallest node."""
    edges = cut(edges)
    before, now = None, _state(edges)
    while now != before:
        tasks = 1 + now[0] // TASK_ROWS  # links never become more, so small rounds need few tasks
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = _with_least(both, least, tasks).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(down, least, tasks).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")).coalesce(tasks))
        edges = cut(small.distinct().coalesce(tasks))
        before, now = now, _state(edges)
    # Edges are stars around the roots now.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_least(links: DataFrame, least: DataFrame, tasks: int) -> DataFrame:
    """Each link with its node's least. A shuffle on either side of the join lets adaptive execution split a hub's links."""
    return links.join(least.repartition("a"), "a").coalesce(tasks)


def _state(edges: DataFrame) -> tuple:
    """How many links there are, and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def label(members: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """members: member (anything that can be ordered; null is the smallest), bits. Adds first, the smallest member of the component."""
    members = members.select("*", F.struct("member").alias("__ef_least"))  # a struct's order counts nulls, min() alone skips them
    prints = cut(members.groupBy("bits").agg(F.min("__ef_least").alias("least"), F.count("*").alias("n")))
    total = prints.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    linked = components(links(prints.select("bits"), file_rows))
    roots = linked.select("root").distinct().select(F.col("root").alias("node"), "root")
    named = cut(linked.union(roots).join(prints, F.col("node") == F.col("bits")).select("bits", "root", "least"))
    firsts = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("n"))
    spread = join_by_key(named, firsts, "root", named.count()).select("bits", "first")
    every = cut(prints.join(spread, "bits", "left").select("bits", "n", F.coalesce("first", "least")["member"].alias("first")))
    return join_by_key(members.drop("__ef_least"), every, "bits", total)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest key; of repeated rows, the first.

    The documents are written with their places first, as a place must not change from one evaluation to the next.
    """
    placed = written(docs.withColumn("__ef_row", F.monotonically_increasing_id()), "placed")
    members = cut(placed.select(F.struct(F.col(key).alias("key"), F.col("__ef_row").alias("row")).alias("member"), fingerprint(text).alias("bits")))
    firsts = label(members).where(F.col("member") == F.col("first")).select(F.col("member.row").alias("__ef_row"))
    return placed.join(firsts, "__ef_row", "left_semi").select(*docs.columns)
