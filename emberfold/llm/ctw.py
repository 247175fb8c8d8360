"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own tree of contexts: the bytes before it, nearest first, up to `DEPTH`.
A node keeps how often its decision went either way. Its Krichevsky-Trofimov estimate and the product of its children's
weighted probabilities are mixed half and half, from the deepest contexts up; the posterior weight of stopping at a node
follows, and a decision's probability mixes the estimates of all depths along its path with these weights. A context
that training has not seen adds nothing to its parent's mixture. A text's score is the log10 probability of its bytes
(A-Z lowered) and of the zero byte that ends it, after `DEPTH` zero bytes; per byte, it is the code length.

As counts are fixed after training, a byte's probability depends on the byte and the bytes before it alone, the gram.
1. Each task cuts its texts into chunks of bounded size, writes each as a file to the shared folder, and counts its
   distinct grams and words, those of texts that do not train with a count of zero. They are packed by bucket of the key.
2. The counts are summed. Grams are dealt out by the two nearest context bytes, so each task holds whole subtrees, below
   depth 2, and weighs some contexts at a time, one bit of the byte after another. A first pass gives what the two top
   depths need, at most 65,536 sums, which go to the driver; a second weighs and mixes.
3. The probabilities of grams and the counts of words meet the chunks' packed keys bucket by bucket and go back to the
   chunks, so a chunk is scored with the numbers of its own keys: nothing that grows with the corpus is broadcast,
   collected or read by every task. A key that all chunks share gives one row in a chunk, whatever the chunk repeats.

Chunks are named by the attempt that wrote them, and only rows of successful tasks name them, so a task that runs twice
leaves a file that nothing reads.

The base score is an add-one unigram model over words, and an end for each text, from the same training texts.

Words are told apart by 64 bits of hash: of a billion distinct words, the chance that any two meet is 3 %.

Defined results: a null text counts as ''. Repeated rows count as often as they are there. With no training texts every
probability is that of an untrained estimate. An empty table gives no rows. Texts of any length are scored whole.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, cut, release_memory, scratch, shuffle_width, whole_text, written

#: Context bytes; a gram must fit in a positive long.
DEPTH = 5
#: Depths that are mixed on the driver's 256 x 256 tables.
TOP = 2
#: Bytes of texts that are counted or scored at a time; a chunk ends at so many bytes or distinct keys.
BUFFER_BYTES, CHUNK_BYTES, CHUNK_KEYS = 1_000_000, 32_000_000, 4_000_000
#: Rows of grams that are weighed at a time, unless one context of two bytes has more.
WEIGHED = 300_000
LOG_HALF = math.log(0.5)
#: Hash of the end of a text among the words.
END = -1


def word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 0)
    return h - (1 << 64) if h >> 63 else h


def _log_gamma_tables(n: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(n, dtype=np.float64)
    half = 0.5 * math.log(math.pi) + np.concatenate([[0.0], np.cumsum(np.log(k[:-1] + 0.5))])
    one = np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
    return half, one


_HALF, _ONE = _log_gamma_tables()


def _log_gamma(n: np.ndarray, small: np.ndarray, shift: float) -> np.ndarray:
    """log gamma(n + shift) for whole n >= 0."""
    x = np.maximum(n, 1.0) + shift
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(small), small[np.minimum(n, len(small) - 1).astype(np.int64)], series)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives a sequence with these counts."""
    return _log_gamma(zeros, _HALF, 0.5) + _log_gamma(ones, _HALF, 0.5) - 2 * _HALF[0] - _log_gamma(zeros + ones, _ONE, 1.0)


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte and end, and which text it is in. Context bytes come first, the nearest as the highest."""
    pad = bytes(depth)
    a = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\0")]), dtype=np.uint8)
    if not len(texts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    keys, n = a[depth:].astype(np.int64), len(a) - depth
    for back in range(1, depth + 1):
        keys |= a[depth - back : depth - back + n].astype(np.int64) << 8 * (depth + 1 - back)
    keep = np.ones(n, dtype=bool)
    gaps = (np.cumsum(lengths + depth)[:-1] - depth)[:, None] + np.arange(depth)
    keep[gaps.reshape(-1)] = False
    return keys[keep], np.repeat(np.arange(len(texts)), lengths)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of keys, merged as they double."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.merged = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append(merged(keys, counts))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.merged + BUFFER_BYTES:
            self.parts = [self.sums()]
            self.held = self.merged = len(self.parts[0][0])

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        return merged(*(np.concatenate(x) for x in zip(*self.parts))) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit values as compressed bytes, place by place; of rising ones, their differences."""
    values = np.diff(values, prepend=np.int64(0)) if rising else values
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), dtype=np.uint8)
    values = np.ascontiguousarray(raw.reshape(8, n).T).view(kind).reshape(-1)
    return np.cumsum(values) if rising else values


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


GRAM, WORD = 0, 1
_CHUNK = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.binary())])


class _Chunk:
    """Texts on their way to a chunk's file, with the counts of their grams and words."""

    def __init__(self, fs, base: str, depth: int, most: int):
        self.name, self.depth, self.most = uuid.uuid4().hex, depth, most
        self.sink = fs.open_output_stream(f"{base}/{self.name}")
        self.file = pa.ipc.new_stream(self.sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.rows: list[tuple] = []
        self.grams, self.words, self.waiting, self.size = Tally(), Tally(), 0, 0

    def add(self, key: int, train: bool, text: bytes) -> None:
        self.rows.append((key, train, text))
        self.waiting += len(text)
        if self.waiting >= min(BUFFER_BYTES, self.most):
            self.flush()

    def full(self) -> bool:
        return self.size >= self.most or self.grams.held + self.words.held >= CHUNK_KEYS

    def flush(self) -> None:
        keys, flags, texts = zip(*self.rows) if self.rows else ((), (), ())
        self.file.write_batch(pa.record_batch([pa.array(x, f.type) for x, f in zip((keys, flags, texts), _CHUNK)], schema=_CHUNK))
        for train in (0, 1):
            some = [t for t, f in zip(texts, flags) if f == train]
            if some:
                found = grams(some, self.depth)[0]
                self.grams.add(found, np.full(len(found), train))
                words = Counter(w for t in some for w in t.split())
                self.words.add(np.array([*map(word_hash, words), END], dtype=np.int64), np.array([*words.values(), len(some)]) * train)
        self.size += self.waiting
        self.rows, self.waiting = [], 0

    def close(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """The file is whole; the packed keys and counts by bucket."""
        self.flush()
        self.file.close()
        self.sink.close()
        for kind, tally in ((GRAM, self.grams), (WORD, self.words)):
            keys, counts = tally.sums()
            of = keys % buckets
            order = np.argsort(of, kind="stable")  # keys stay sorted within a bucket
            keys, counts, edges = keys[order], counts[order], np.searchsorted(of[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edges))
            packed = [(pack(keys[a:b], rising=True), pack(counts[a:b])) for a, b in zip(edges[some], edges[some + 1])]
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int8()), pa.array(some, pa.int32()), pa.array([self.name] * n), pa.array([k for k, _ in packed], pa.binary()), pa.array([c for _, c in packed], pa.binary())], ["kind", "bucket", "chunk", "keys", "numbers"])


def _open(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def _counting(folder: str, buckets: int, depth: int, chunk_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, base), chunk = _open(folder), None
        for batch in batches:
            for key, train, text in zip(batch["doc_id"].to_pylist(), batch["train"].to_pylist(), batch["text"]):
                chunk = chunk or _Chunk(fs, base, depth, chunk_bytes)
                chunk.add(key, train, text.as_py().encode().lower())
                if chunk.full():
                    yield from chunk.close(buckets)
                    chunk = None
        if chunk:
            yield from chunk.close(buckets)
        chunk = None
        release_memory()

    return count


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of packed rows, summed while the bucket stays."""
    tally, at = Tally(), None
    for batch in batches:
        for kind, bucket, keys, counts in zip(batch["kind"].to_pylist(), batch["bucket"].to_pylist(), batch["keys"].to_pylist(), batch["numbers"].to_pylist()):
            if at and at != (kind, bucket):
                yield _counts(at[0], tally)
                tally = Tally()
            at = kind, bucket
            tally.add(unpack(keys, np.int64, rising=True), unpack(counts, np.int64))
    if at:
        yield _counts(at[0], tally)
    release_memory()


def _counts(kind: int, tally: Tally) -> pa.RecordBatch:
    keys, counts = tally.sums()
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), pa.array(counts)], ["kind", "key", "n"])


def look_up(keys: np.ndarray, have: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of keys, all of which are there. have: sorted."""
    at = np.minimum(np.searchsorted(have, keys), max(0, len(have) - 1))
    if len(keys) and (not len(have) or (have[at] != keys).any()):
        raise ValueError("a key was scored that was not counted")
    return values[at] if len(have) else np.zeros(0)


def _given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, first keys with their values, then chunks' packed keys: these with their values."""
    at, parts, table = None, [], None
    for batch in batches:
        kinds, buckets, single = batch["kind"].to_numpy(), batch["bucket"].to_numpy(), batch["chunk"].is_null().to_numpy(zero_copy_only=False)
        name = kinds.astype(np.int64) << 32 | buckets
        edges = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (single[1:] != single[:-1]), [True]])) if len(name) else []
        for a, b in zip(edges, edges[1:]):
            if at != name[a]:
                at, parts, table = name[a], [], None
            run = batch.slice(a, b - a)
            if single[a]:
                parts.append((run["key"].to_numpy(), run["value"].to_numpy()))
                continue
            if table is None:
                have, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
                order = np.argsort(have)
                table, parts = (have[order], values[order]), []
            found = [pack(look_up(unpack(k, np.int64, rising=True), *table)) for k in run["keys"].to_pylist()]
            yield pa.RecordBatch.from_arrays([run["kind"], run["bucket"], run["chunk"], run["keys"], pa.array(found, pa.binary())], ["kind", "bucket", "chunk", "keys", "numbers"])
    release_memory()


class Subtrees:
    """Nodes below the top depths, for all grams of some context suffixes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = TOP):
        self.keys, self.depth, self.top = keys, depth, top
        rows, n = keys, counts.astype(np.float64)
        #: By depth: rows of (context, next byte); their counts; of each row one depth deeper, its row here.
        self.rows, self.counts, self.up = {depth: rows}, {depth: n}, {}
        for d in range(depth - 1, top - 1, -1):
            rows, up = np.unique((rows >> 16) << 8 | rows & 255, return_inverse=True)
            n = np.bincount(up, weights=n, minlength=len(rows))
            self.rows[d], self.counts[d], self.up[d] = rows, n, up

    def weighed(self, level: int) -> dict[int, tuple[np.ndarray, ...]]:
        """By depth, for one bit of the byte: each row's node, and the nodes' zeros, ones, weight of stopping, log weight and name."""
        out, below = {}, None
        for d in range(self.depth, self.top - 1, -1):
            rows, n = self.rows[d], self.counts[d]
            name = (rows >> 8) << 8 | (1 << level) | (rows & 255) >> (8 - level)
            first = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, dtype=bool)
            node, size = np.cumsum(first) - 1, int(first.sum())
            ones = np.bincount(node, weights=n * (rows >> (7 - level) & 1), minlength=size)
            zeros = np.bincount(node, weights=n, minlength=size) - ones
            log_e = log_kt(zeros, ones)
            if below is None:
                log_w, stop = log_e, np.ones(size)
            else:
                child_first, child_w = below
                through = np.bincount(node[self.up[d][child_first]], weights=child_w, minlength=size)
                log_w = np.logaddexp(log_e, through) + LOG_HALF
                stop = np.exp(np.minimum(0.0, log_e + LOG_HALF - log_w))
            out[d], below = (node, zeros, ones, stop, log_w, name[first]), (np.flatnonzero(first), log_w)
        return out

    def for_top(self) -> tuple[np.ndarray, np.ndarray]:
        """By nearest byte: counts of the next byte; sums of the children's log weights by bit prefix."""
        counts, sums = np.zeros((256, 256)), np.zeros((256, 256))
        rows = self.rows[self.top]
        np.add.at(counts, (rows >> 16, rows & 255), self.counts[self.top])
        for level in range(8):
            *_, log_w, name = self.weighed(level)[self.top]
            np.add.at(sums, (name >> 16, name & 255), log_w)
        return counts, sums

    def log10_probabilities(self, top: Top) -> np.ndarray:
        """Of every gram."""
        out = np.zeros(len(self.keys))
        nearest, byte = self.keys >> 8 * self.depth, self.keys & 255
        for level in range(8):
            bit, prefix = byte >> (7 - level) & 1, (1 << level) | byte >> (8 - level)
            p, seen, row, at = None, False, np.arange(len(self.keys)), self.weighed(level)
            for d in range(self.depth, self.top - 1, -1):
                if d < self.depth:
                    row = self.up[d][row]
                node, zeros, ones, stop, _, _ = at[d]
                node = node[row]
                p, seen = mix(p, seen, bit, zeros[node], ones[node], stop[node])
            p, seen = mix(p, seen, bit, top.zeros[nearest, prefix], top.ones[nearest, prefix], top.stop[nearest, prefix])
            p, _ = mix(p, seen, bit, top.root_zeros[prefix], top.root_ones[prefix], top.root_stop[prefix])
            out += np.log10(p)
        return out


def mix(below, seen, bit, zeros, ones, stop):
    """The probability of a bit at a node, from that of its child on the path, and whether training saw this node."""
    own = (np.where(bit == 1, ones, zeros) + 0.5) / (zeros + ones + 1.0)
    p = own if below is None else np.where(seen, stop * own + (1 - stop) * below, own)
    return p, zeros + ones > 0


def _bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of next bytes in the last axis, as counts of zeros and ones by bit prefix."""
    zeros, ones = np.zeros_like(counts), np.zeros_like(counts)
    for level in range(8):
        blocks = counts.reshape(*counts.shape[:-1], 1 << level, 2, -1).sum(axis=-1)
        zeros[..., 1 << level : 2 << level], ones[..., 1 << level : 2 << level] = blocks[..., 0], blocks[..., 1]
    return zeros, ones


class Top:
    """Depths 0 and 1, from the sums of all subtrees."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray):
        self.zeros, self.ones = _bit_counts(counts)
        log_e = log_kt(self.zeros, self.ones)
        log_w = np.logaddexp(log_e, sums) + LOG_HALF
        self.stop = np.exp(np.minimum(0.0, log_e + LOG_HALF - log_w))
        self.root_zeros, self.root_ones = self.zeros.sum(axis=0), self.ones.sum(axis=0)
        log_e = log_kt(self.root_zeros, self.root_ones)
        used = self.zeros + self.ones > 0
        log_w = np.logaddexp(log_e, np.where(used, log_w, 0.0).sum(axis=0)) + LOG_HALF
        self.root_stop = np.exp(np.minimum(0.0, log_e + LOG_HALF - log_w))


def _some_contexts(batches: Iterator[pa.RecordBatch], depth: int, at_once: int) -> Iterator[Subtrees]:
    """Subtrees of whole contexts of two bytes, some rows or so at a time. Rows come sorted by key."""
    shift, keys, counts = 8 * (depth + 1 - TOP), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys, counts = np.concatenate([keys, batch["key"].to_numpy()]), np.concatenate([counts, batch["n"].to_numpy()])
        if len(keys) >= at_once:
            end = np.searchsorted(keys, keys[-1] >> shift << shift)  # the last context may go on
            if end:
                yield Subtrees(keys[:end], counts[:end], depth)
                keys, counts = keys[end:], counts[end:]
    if len(keys):
        yield Subtrees(keys, counts, depth)


class Totals:
    """Of the training texts: all tokens, distinct tokens."""

    def __init__(self, tokens: int, distinct: int, depth: int):
        self.train_tokens, self.distinct_tokens, self.depth = tokens, distinct, depth


def score_texts(texts: list[bytes], probabilities, word_counts, totals: Totals) -> tuple[np.ndarray, ...]:
    """Score, base score, tokens and known tokens of lowered texts."""
    keys, of = grams(texts, totals.depth)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    values = probabilities(keys[first])
    score = np.bincount(of[order], weights=np.repeat(values, np.diff(np.append(first, len(keys)))), minlength=len(texts))
    ids: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    at = np.array([ids.setdefault(w, len(ids)) for words in split for w in words], dtype=np.int64)
    lengths = np.array([len(words) for words in split], dtype=np.int64)
    hashes = np.array([*map(word_hash, ids), END], dtype=np.int64)
    order = np.argsort(hashes)
    have = np.empty(len(hashes))
    have[order] = word_counts(hashes[order])
    logs = np.log10((have + 1.0) / (totals.train_tokens + totals.distinct_tokens + 1.0))
    owner = np.repeat(np.arange(len(texts)), lengths)
    base = np.bincount(owner, weights=logs[at], minlength=len(texts)) + logs[-1]
    known = np.bincount(owner, weights=have[at] > 0, minlength=len(texts)).astype(np.int64) + int(have[-1] > 0)
    return score, base, lengths + 1, known


def _probabilities(counts: DataFrame, depth: int, at_once: int) -> DataFrame:
    """counts: key, n. The log10 probability of every gram: key, value."""
    spark = counts.sparkSession
    dealt = counts.repartition(shuffle_width(spark), F.shiftright("key", 8 * (depth + 1 - TOP))).sortWithinPartitions("key")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((256, 256)), np.zeros((256, 256))
        for trees in _some_contexts(batches, depth, at_once):
            more_n, more_s = trees.for_top()
            n, s = n + more_n, s + more_s
        at = np.flatnonzero((n != 0) | (s != 0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.ravel()[at]), pa.array(s.ravel()[at])], ["at", "n", "s"])

    n, s = np.zeros(65_536), np.zeros(65_536)
    for row in dealt.mapInArrow(sums, "at int, n double, s double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        n[row["at"]], s[row["at"]] = row["n"], row["s"]
    top = spark.sparkContext.broadcast(Top(n.reshape(256, 256), s.reshape(256, 256)))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trees in _some_contexts(batches, depth, at_once):
            yield pa.RecordBatch.from_arrays([pa.array(trees.keys), pa.array(trees.log10_probabilities(top.value))], ["key", "value"])
        release_memory()

    return dealt.mapInArrow(weighed, "key long, value double")


def _scored(folder: str, totals: Totals):
    def chunk_scores(name: str, own: dict[int, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        tables = {}
        for kind, parts in own.items():
            keys, values = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            tables[kind] = keys[order], values[order]
            parts.clear()
        fs, base = _open(folder)
        with fs.open_input_stream(f"{base}/{name}") as source, pa.ipc.open_stream(source) as file:
            for batch in file:
                texts = batch["text"].to_pylist()
                if texts:
                    s, b, n, known = score_texts(texts, lambda k: look_up(k, *tables[GRAM]), lambda k: look_up(k, *tables[WORD]), totals)
                    yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["train"], pa.array(s), pa.array(b), pa.array(n), pa.array(known), pa.array([len(t) + 1 for t in texts], pa.int64())], ["doc_id", "train", "score", "base_score", "n_tokens", "n_known", "n_bytes"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by chunk."""
        at, own = None, {GRAM: [], WORD: []}
        for batch in batches:
            for chunk, kind, keys, values in zip(batch["chunk"].to_pylist(), batch["kind"].to_pylist(), batch["keys"].to_pylist(), batch["numbers"].to_pylist()):
                if at not in (None, chunk):
                    yield from chunk_scores(at, own)
                    own = {GRAM: [], WORD: []}
                at = chunk
                own[kind].append((unpack(keys, np.int64, rising=True), unpack(values, np.float64)))
        if at:
            yield from chunk_scores(at, own)
        own = None
        release_memory()

    return scored


def score(docs: DataFrame, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES, at_once: int = WEIGHED) -> tuple[DataFrame, Totals]:
    """docs: doc_id, text, train boolean. Learns from the training rows and scores all: doc_id, train, score, base_score,
    n_tokens, n_known and n_bytes; and what training counted."""
    spark = docs.sparkSession
    width, folder = shuffle_width(spark), re.sub(r"^file:/(?!/)", "file:///", scratch(spark, "chunks"))
    buckets = _prime(4 * width)
    found = docs.select("doc_id", "train", "text").mapInArrow(_counting(folder, buckets, depth, chunk_bytes), "kind byte, bucket int, chunk string, keys binary, numbers binary")
    packed = written(found.repartition(width, "kind", "bucket").sortWithinPartitions("kind", "bucket"), "packed")
    counts = cut(packed.select("kind", "bucket", "keys", "numbers").mapInArrow(_summed, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words = counts.where(F.col("kind") == WORD)
    distinct, tokens = words.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    totals = Totals(int(tokens), int(distinct), depth)
    values = _probabilities(counts.where(F.col("kind") == GRAM).select("key", "n"), depth, at_once).select(F.lit(GRAM).cast("byte").alias("kind"), "key", "value")
    values = values.union(words.select("kind", "key", F.col("n").cast("double")))
    bucket = F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")
    none = lambda kind: F.lit(None).cast(kind)
    singles = values.select("kind", bucket, none("string").alias("chunk"), none("binary").alias("keys"), "key", "value")
    asked = packed.select("kind", "bucket", "chunk", "keys", none("long").alias("key"), none("double").alias("value"))
    met = singles.union(asked).repartition(width, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("chunk").asc_nulls_first())
    back = met.mapInArrow(_given_back, "kind byte, bucket int, chunk string, keys binary, numbers binary")
    mine = back.repartition(width, "chunk").sortWithinPartitions("chunk")
    return mine.mapInArrow(_scored(folder, totals), "doc_id long, train boolean, score double, base_score double, n_tokens long, n_known long, n_bytes long"), totals


def split_by_key(docs: DataFrame, modulus: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text"), (bucket_of(key, modulus) != held_out).alias("train"))
