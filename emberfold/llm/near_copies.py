"""Near copies by the Jaccard similarity of word shingles, for the pipeline.

Documents link when the sets of their five-word shingles (lowered and split as SimHash's) have a similarity of `LEAST` or
more. Texts with equal sets are folded first, so everything after works on distinct sets.

The method is SimHash's through pivot distance tables, as in simhash.py, at the distance that this similarity needs. A
fingerprint has `BITS` bits, each set if over half of the shingles' hashes set it. A bit of a pair at 0.8 differs with a
chance of 0.15, of at most 0.19 in sets of a few shingles, so a pair that differs in more than `FAR` bits, five deviations
above, is none. Pivots are fingerprints of the centres (below) that most bands share: the Hamming distances of every
fingerprint to them are computed once, and a pair whose distances to a pivot differ by more than `FAR` is discarded without
being compared, by the triangle inequality. That parts members of the largest groups from other rows; a pair that is far
from all pivots is compared. Survivors are verified bit by bit, and then exactly by their shingles.

op10 files fingerprints by their blocks. Here no file of blocks can hold a pair: of blocks of 16 bits some 180 a
fingerprint would have to be filed to miss one in a million. Files are MinHash bands instead, 32 of 4 of a set's 128
smallest hashes. A pair at 0.8 shares no band once in 20 million times.

1. Each set meets the smallest set of each of its bands, its centres, and is verified by its shingles against the smallest
   of these that is near: a link for most members of a group, however large. A centre with many members is dealt out by salt.
2. In bands that still hold more than one component, near pairs of different components are looked for by their
   fingerprints; a task gives a spanning forest of them, not the pairs. With the links they make clusters.
3. In a cluster of more than one component all pairs of different components are compared exactly, by lists of the sets
   that hold each shingle; a task gives a spanning forest of the links.

Bands and clusters with more than `FILE_ROWS` members (clusters: or `FILE_BYTES` of text) are dealt out by pairs of
blocks, so that none meets in one task and no pair is missed. All links of all pairs are found, but each component gives
no more rows than its members and files.

Defined results: null and empty texts are copies of each other. Texts of under five words are one shingle. Rows of one
key are members like any others. A null key is the smallest. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key, picked, release_memory, with_computed, written
from .simhash import components

WORDS, SEED, LEAST = 5, 42, 0.8
BANDS, ROWS = 32, 4
BITS, FAR, PIVOTS = 1024, 256, 24
FILE_ROWS, FILE_BYTES, STAR_ROWS = 2048, 16_000_000, 512
_MIX = np.array([[xxhash.xxh64_intdigest(b"%s %d" % (kind, i), 0) | 1 for i in range(BANDS * ROWS)] for kind in (b"add", b"times")], dtype=np.uint64)
_SALTS = np.array([xxhash.xxh64_intdigest(b"bits %d" % i, 0) for i in range(BITS // 64)], dtype=np.uint64)
_KIND = "struct<same:long,size:long,print:binary,bands:array<long>>"


def shingles_of(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    found = text.encode().lower().split()
    tails = [found[k:] for k in range(words)] if len(found) >= words else [[b" ".join(found)]] if found else []
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join(digest(b" ".join(s), SEED) for s in zip(*tails)), dtype=np.uint64))


def fingerprint_of(shingles: np.ndarray) -> bytes:
    """A bit is set if more than half of the shingles' hashes set it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for first in range(0, len(shingles), 255):  # as many as a byte counts
        ones += np.unpackbits(_mixed(shingles[first : first + 255]).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def _mixed(shingles: np.ndarray) -> np.ndarray:
    """`BITS` bits of each shingle's hash, by SplitMix64's steps."""
    x = shingles[:, None] ^ _SALTS
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch_of(shingles: np.ndarray) -> tuple[int, bytes, list[int]]:
    """A digest of the set, its fingerprint and its bands."""
    if not len(shingles):
        return 0, bytes(BITS // 8), []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for first in range(0, len(shingles), 512):
        least = np.minimum(least, ((shingles[first : first + 512, None] ^ _MIX[0]) * _MIX[1]).min(axis=0))
    raw, step = least.tobytes(), 8 * ROWS
    bands = [_signed(xxhash.xxh64_intdigest(raw[step * i : step * (i + 1)], i)) for i in range(BANDS)]
    return _signed(xxhash.xxh64_intdigest(shingles.tobytes(), SEED)), fingerprint_of(shingles), bands


def _signed(x: int) -> int:
    return x - (1 << 64) * (x >> 63)


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets of shingles."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _sketches(texts: list[str]) -> pa.Array:
    same, prints, bands = zip(*(sketch_of(shingles_of(t)) for t in texts))
    size = pa.array([len(t) for t in texts], pa.int64())
    return pa.StructArray.from_arrays([pa.array(same, pa.int64()), size, pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["same", "size", "print", "bands"])


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)


def _distances(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, PIVOTS)


def _near(a: np.ndarray, b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> np.ndarray:
    """Which pairs differ in `FAR` bits at most; those that the pivots discard are not compared."""
    near = np.abs(from_a - from_b).max(axis=1, initial=0) <= FAR
    near[near] = np.bitwise_count(a[near] ^ b[near]).sum(axis=1) <= FAR
    return near


def _likely(a: pa.Array, b: pa.Array, from_a: pa.Array, from_b: pa.Array) -> pa.Array:
    return pa.array(_near(_prints(a), _prints(b), _distances(from_a), _distances(from_b)))


def pivot_distances(prints: np.ndarray, pivots: list[bytes]) -> np.ndarray:
    """Of each fingerprint to each of `PIVOTS` pivots; where there are fewer, the rest is the fingerprint without bits."""
    full = [*pivots, *[bytes(BITS // 8)] * (PIVOTS - len(pivots))]
    return np.stack([np.bitwise_count(prints ^ np.frombuffer(p, dtype=np.uint64)).sum(axis=1) for p in full], axis=1).astype(np.int16)


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Forest:
    """Rows that are joined step by step; rows of one file and root are joined from the start."""

    def __init__(self, file: np.ndarray, root: np.ndarray):
        self.parent, order = np.arange(len(file)), np.lexsort((root, file))
        new = np.ones(len(file), dtype=bool)
        new[1:] = (file[order][1:] != file[order][:-1]) | (root[order][1:] != root[order][:-1])
        self.parent[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(file)), 0))]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.parent[a] = b
        return a != b

    def flatten(self) -> None:
        while (self.parent != (up := self.parent[self.parent])).any():
            self.parent = up


def _files(batches: Iterator[pa.RecordBatch], column: str = "file") -> Iterator[pa.Table]:
    """Rows come sorted by file, and a file is whole within the partition."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        names = batch[column].to_numpy()
        edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if waiting and waiting[0][column][0].as_py() != names[a]:
                    yield pa.Table.from_batches(waiting)
                    waiting = []
                waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the near pairs of different components; rows come sorted by file."""
    kept = None
    for batch in batches:
        now = tuple(batch[c].to_numpy() for c in ("file", "same", "root")) + (_prints(batch["print"]), _distances(batch["distances"]))
        if kept is not None:
            now = tuple(np.concatenate(x) for x in zip(kept, now))
        if not len(now[0]):
            continue
        open_from = int(np.flatnonzero(now[0] != now[0][-1]).max(initial=-1)) + 1
        kept = tuple(x[open_from:].copy() for x in now)  # the last file may go on in the next batch
        yield _apart_in(*(x[:open_from] for x in now))
    if kept is not None:
        yield _apart_in(*kept)


def _apart_in(file: np.ndarray, same: np.ndarray, root: np.ndarray, prints: np.ndarray, distances: np.ndarray) -> pa.RecordBatch:
    forest, at, step, links = _Forest(file, root), np.arange(len(same) - 1), 1, []
    while len(at := at[at + step < len(same)]):
        at, found = at[file[at] == file[at + step]], len(links)
        new = at[forest.parent[at] != forest.parent[at + step]]
        for part in np.array_split(new, len(new) // 65_536 + 1):
            near = part[_near(prints[part], prints[part + step], distances[part], distances[part + step])]
            links += [(i, i + step) for i in near.tolist() if forest.join(i, i + step)]
        if len(links) > found:
            forest.flatten()
        step += 1
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return _pairs(same[a], same[b])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links between different components of each file."""
    for file in _files(batches):
        root = file["root"].to_numpy()
        if (root != root[0]).any():
            yield _linked_in(file["same"].to_numpy(), root, file["text"])
    release_memory()


def _linked_in(same: np.ndarray, root: np.ndarray, texts: pa.ChunkedArray) -> pa.RecordBatch:
    sets = [shingles_of(t.as_py()) for t in texts]
    size, n = np.array([len(x) for x in sets]), len(sets)
    shingle, places = np.unique(np.concatenate(sets), return_inverse=True)
    # For each shingle the rows that hold it, one list after the other.
    holders = np.repeat(np.arange(n), size)[np.argsort(places, kind="stable")]
    count = np.bincount(places, minlength=len(shingle))
    start, own = np.cumsum(count) - count, np.append(0, np.cumsum(size))
    forest, links = _Forest(np.zeros(n, dtype=np.int64), root), []
    _, kind, times = np.unique(root, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(kind != times.argmax()).tolist():  # a pair of different components has one of these
        of = places[own[i] : own[i + 1]]
        many = count[of]
        lists = np.repeat(start[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(holders[lists], minlength=n)
        near = np.flatnonzero(both / (size[i] + size - both) >= LEAST)
        links += [(i, int(j)) for j in near if forest.join(i, int(j))]
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return _pairs(same[a], same[b])


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that are linked to their centre, whose text comes before them."""
    centre, key = None, None
    for batch in batches:
        a, b = [], []
        for row in batch.to_pylist():
            shingles = shingles_of(row["text"])
            if not row["leaf"]:
                centre, key = shingles, row["b"]
            elif key == row["b"] and similarity(shingles, centre) >= LEAST:
                a.append(row["same"])
                b.append(key)
        yield _pairs(a, b)
    release_memory()


def _with_text(named: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """named: same; texts: row, text. Adds a text of each set. Only these texts are shuffled."""
    named = cut(named.join(sets.select("same", "row"), "same"))
    return named.join(picked(texts, named.select("row"), "row"), "row").drop("row").withColumn("text", F.coalesce("text", F.lit("")))


def _verified(stars: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """stars: a, b, each a once. Those that are linked. Each text is read once, a centre's once for each of its salts."""
    sizes = cut(stars.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count("*") / STAR_ROWS).alias("salts")))
    salted = join_by_key(stars, sizes, "b", stars.count())
    leaves = salted.select(F.col("a").alias("same"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), F.lit(1).alias("leaf"))
    centres = leaves.select(F.col("b").alias("same"), "b", "salt", F.lit(0).alias("leaf")).distinct()
    both = _with_text(leaves.union(centres), sets, texts)
    return both.repartition("b", "salt").sortWithinPartitions("b", "salt", "leaf").mapInArrow(_star, "a long, b long")


def _mixed_groups(rows: DataFrame, group: str, file_rows: int, size: Column | None = None) -> DataFrame:
    """rows: group, root. The groups of more than one component: group, n, big, few and many.

    big is the component with most rows; the other rows make `few` blocks and its own `many`. A group of one file has one
    block and none.
    """
    of = rows.groupBy(group, "root").agg(F.count("*").alias("n"), (F.lit(0) if size is None else F.sum(size)).cast("long").alias("bytes"))
    top = F.max(F.struct("n", "bytes", F.col("root").alias("big"))).alias("top")
    all_of = of.groupBy(group).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("roots"), top).where("roots > 1")
    blocks = lambda n, size: F.ceil(F.greatest(n * 2 / file_rows, size * 2 / FILE_BYTES))
    crowded = (F.col("n") > file_rows) | (F.col("bytes") > FILE_BYTES)
    few = F.when(crowded, F.greatest(F.lit(1), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")))).otherwise(1)
    many = F.when(crowded, F.greatest(F.lit(1), blocks(F.col("top.n"), F.col("top.bytes")))).otherwise(0)
    return all_of.select(group, "n", "top.big", few.cast("long").alias("few"), many.cast("long").alias("many"))


def _dealt(rows: DataFrame, group: str, mixed: DataFrame) -> DataFrame:
    """mixed: `_mixed_groups`. Rows with a file: each two rows of a group meet in one, but for two of its largest component.

    Rows of the largest component go to a file for each block of other rows, and only these to all; so a group grows by
    how many rows its largest component lacks. A shuffle on either side of the join lets adaptive execution split a large
    group's rows.
    """
    rows = rows.join(mixed.select(group, "big", "few", "many").repartition(group), group)
    inside = (F.col("root") == F.col("big")) & (F.col("many") > 0)
    of = F.xxhash64("same")
    rows = rows.withColumn("own", F.when(inside, F.col("few") + F.pmod(of, F.greatest("many", F.lit(1).cast("long")))).otherwise(F.pmod(of, F.col("few"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") + F.when(inside, 0).otherwise(F.col("many")) - 1)))
    return rows.withColumn("file", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).drop(group, "big", "few", "many", "own", "other")


def _located(banded: DataFrame, sets: DataFrame) -> DataFrame:
    """same, print, distances: the table of every fingerprint's distances to the pivots, the centres of most band members."""
    most = banded.groupBy("b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "b").limit(PIVOTS).select(F.col("b").alias("same"))
    pivots = [bytes(r["print"]) for r in sets.select("same", "print").join(F.broadcast(cut(most)), "same").orderBy("same").collect()]

    @F.arrow_udf("binary")
    def distances(prints: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in pivot_distances(_prints(prints), pivots)], pa.binary())

    return written(sets.select("same", "print", distances("print").alias("distances")), "located")


def _rest(banded: DataFrame, located: DataFrame, roots: DataFrame, file_rows: int) -> DataFrame:
    """A forest of near pairs that share a band and no component yet."""
    rooted = _rooted(banded, roots)
    filed = _dealt(rooted, "band", _mixed_groups(rooted, "band", file_rows))
    with_print = filed.join(located, "same").repartition("file").sortWithinPartitions("file")
    return with_print.mapInArrow(_apart, "a long, b long").distinct()


def _exact(likely: DataFrame, found: DataFrame, roots: DataFrame, sets: DataFrame, texts: DataFrame, file_rows: int) -> DataFrame:
    """The links inside clusters of more than one component."""
    clusters = named_roots(components(found.union(likely))).withColumnRenamed("root", "cluster")
    members = _rooted(clusters, roots).join(sets.select("same", "size"), "same")
    mixed = cut(_mixed_groups(members, "cluster", file_rows, F.col("size")))
    few = _with_text(members.join(mixed.select("cluster"), "cluster", "left_semi").select("same", "root", "cluster"), sets, texts)
    return _dealt(few, "cluster", mixed).repartition("file").sortWithinPartitions("file").mapInArrow(_linked, "a long, b long")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows with the root of their set, which is the set itself where it has no link."""
    return rows.join(roots, "same", "left").withColumn("root", F.coalesce("root", "same"))


def named_roots(linked: DataFrame) -> DataFrame:
    """same, root, roots included."""
    return linked.select(F.col("node").alias("same"), "root").union(linked.select(F.col("root").alias("same"), "root").distinct())


def links(sets: DataFrame, texts: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """sets: same, row, size, print, bands; texts: row, text. Rows (a, b) whose components are those of all linked pairs."""
    banded = sets.select("same", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("same").alias("b"), F.count("*").alias("n")).where("n > 1")
    banded = cut(banded.join(shared.select("band", "b").repartition("band"), "band"))  # as in _dealt
    located, likely = _located(banded, sets), F.arrow_udf(_likely, "boolean")
    place = lambda x: located.select(F.col("same").alias(x), F.col("print").alias(f"print_{x}"), F.col("distances").alias(f"from_{x}"))
    stars = banded.select(F.col("same").alias("a"), "b").where("a != b").distinct()
    stars = stars.join(place("a"), "a").join(place("b"), "b").where(likely("print_a", "print_b", "from_a", "from_b")).groupBy("a").agg(F.min("b").alias("b"))
    found = cut(_verified(cut(stars), sets, texts))
    roots = cut(named_roots(components(found)))
    rest = cut(_rest(banded.select("same", "band"), located, roots, file_rows))
    return found.union(_exact(rest, found, roots, sets, texts, file_rows))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", file_rows: int = FILE_ROWS) -> DataFrame:
    """One document of each component, the one with the smallest key; of repeated rows, the first.

    The documents are written with their places first, as a place must not change from one evaluation to the next.
    """
    placed = written(docs.withColumn("__ef_row", F.monotonically_increasing_id()), "placed")
    slim = placed.select(F.col(key).alias("key"), F.col("__ef_row").alias("row"), F.col(text).alias("text"))
    sketched = with_computed(slim, "of", _KIND, _sketches, keep=["key", "row"]).select(F.struct("key", "row").alias("member"), "of.*")
    # Copies have the same fingerprint and bands, so any of a set's rows gives them.
    sets = written(sketched.groupBy("same").agg(F.min("member").alias("member"), F.max("size").alias("size"), F.first("print").alias("print"), F.first("bands").alias("bands")), "sets").withColumn("row", F.col("member.row"))
    linked = components(links(sets, slim.select("row", "text"), file_rows))
    named = sets.select("same", "member").join(linked.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))
    firsts = named.groupBy("root").agg(F.min("member").alias("member")).select(F.col("member.row").alias("__ef_row"))
    return picked(placed, firsts, "__ef_row").select(*docs.columns)
