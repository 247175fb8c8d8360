"""Token ids in files of patched frame-of-reference blocks.

A block holds up to `BLOCK` ids. Its least id is taken off, the rest are packed at a width that a percentile of them
fits; those that do not fit keep their low bits in place, and an exception list holds their places and high bits. A file
is a header, the blocks, then an index: where each block starts, and where each document's ids start. So one document
can be read without its file's other blocks.

Layout, little-endian: b"EFT1"; the blocks, each with base u32, count u16, width u8, a pad byte, exceptions u16, a pad of
two, packed bits, exception places u16, exception high bits u32; block starts u64; document starts u64; document ids i64;
then the numbers of blocks, documents and ids, u64 each.

Documents are range-partitioned by doc_id, each partition is sorted and written as one file to the shared folder, named
by its number and the attempt. Only rows of successful tasks name files, so a task that runs twice or is lost leaves a
file that nothing reads. The files' id totals, one row each, give by a running sum where each file starts. Reading maps
over those rows, a task per file, which reads the index and then some blocks at a time.

Defined results: a null or empty text has its end id only; rows of one doc_id are in order of their texts' hashes; a null
doc_id comes first. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Cache
from .common import scratch, shuffle_width, whole_text

MAGIC, BLOCK, PERCENTILE, END_ID = b"EFT1", 4096, 98, 1
#: The library is slow on single words, so more of them are kept than for the encoder of `bpe`.
LIBRARY_CACHE = 800_000
_HEAD = struct.Struct("<IHBxHxx")
_TAIL = struct.Struct("<QQQ")


class LibraryEncoder:
    """The tokenizers library, called for the stretches of a text that are not in the cache.

    A stretch is what stands between ASCII white space: the library's pieces never span it, so the ids of a text are
    those of its stretches. That holds for tokenizers that drop white space; others are called with whole texts.
    """

    def __init__(self, path: str):
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_stretch = any(p["type"] == "Split" and p.get("invert") and p["behavior"] == "Removed" for p in parts)
        self.cache = Cache(self._encode, LIBRARY_CACHE)

    def _encode(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes) -> bytes:
        """text: in UTF-8."""
        return self.cache.of_text(text) if self.by_stretch else self._encode(text.decode())


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """One block."""
    base = int(ids.min())
    rest = (ids - base).astype(np.uint32)
    width = int(np.sort(rest)[(len(rest) - 1) * percentile // 100]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    low = rest & np.uint32((1 << width) - 1)
    bits = np.unpackbits(low.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    high = (rest[over] >> np.uint32(width)).astype("<u4")
    return _HEAD.pack(base, len(ids), width, len(over)) + np.packbits(bits.reshape(-1), bitorder="little").tobytes() + over.astype("<u2").tobytes() + high.tobytes()


def unpack(data: memoryview, at: int) -> np.ndarray:
    """The block that starts at a place."""
    base, count, width, exceptions = _HEAD.unpack_from(data, at)
    at += _HEAD.size
    size = (count * width + 7) // 8
    rest = np.zeros(count, dtype=np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=count * width).reshape(count, width)
        whole = np.zeros((count, 32), dtype=np.uint8)
        whole[:, :width] = bits
        rest = np.packbits(whole, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)
    at += size
    if exceptions:
        places = np.frombuffer(data, "<u2", exceptions, at)
        rest[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
    return rest + np.uint32(base)


class FileWriter:
    """Collects documents and writes blocks as they fill, so memory holds one block and the index."""

    def __init__(self, sink):
        self.sink, self.at, self.waiting, self.blocks, self.starts, self.keys, self.n = sink, len(MAGIC), [], [], [], [], 0
        self.held = 0
        sink.write(MAGIC)

    def add(self, key: int, ids: np.ndarray) -> None:
        self.starts.append(self.n)
        self.keys.append(key)
        self.n += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK:
            self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, dtype=np.uint32)
        for i in range(0, upto, BLOCK):
            self.blocks.append(self.at)
            data = pack(ids[i : min(i + BLOCK, upto)])
            self.sink.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(self.held)
        for values, kind in ((self.blocks, "<u8"), (self.starts, "<u8"), (self.keys, "<i8")):
            self.sink.write(np.array(values, dtype=kind).tobytes())
        self.sink.write(_TAIL.pack(len(self.blocks), len(self.starts), self.n))


class FileReader:
    """Random access to a file's ids and documents."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        if size < len(MAGIC) + _TAIL.size or source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        blocks, docs, self.n = _TAIL.unpack(source.read_at(_TAIL.size, size - _TAIL.size))
        at = size - _TAIL.size - 8 * (blocks + 2 * docs)
        index = source.read_at(8 * (blocks + 2 * docs), at)
        #: Where each block starts, and the last one ends.
        self.blocks = np.append(np.frombuffer(index, "<u8", blocks), np.uint64(at))
        self.starts = np.frombuffer(index, "<u8", docs, 8 * blocks).astype(np.int64)
        self.keys = np.frombuffer(index, "<i8", docs, 8 * (blocks + docs))

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from one place to another: only their blocks are read."""
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // BLOCK, (end - 1) // BLOCK + 1
        offset = int(self.blocks[first])
        data = memoryview(self.source.read_at(int(self.blocks[last]) - offset, offset))
        some = np.concatenate([unpack(data, int(self.blocks[b]) - offset) for b in range(first, last)])
        return some[start - first * BLOCK : end - first * BLOCK]

    def documents(self, at_once: int = 256) -> Iterator[tuple[int, int, np.ndarray]]:
        """Key, start and ids of each document, in order; blocks are unpacked once, some documents at a time."""
        ends = np.append(self.starts[1:], self.n)
        for i in range(0, len(self.starts), at_once):
            j = min(i + at_once, len(self.starts))
            some = self.ids(int(self.starts[i]), int(ends[j - 1]))
            for k in range(i, j):
                a, b = int(self.starts[k] - self.starts[i]), int(ends[k] - self.starts[i])
                yield int(self.keys[k]), int(self.starts[k]), some[a:b]


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(folder: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", folder)


NULL_KEY = -(1 << 63)


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the files; a lazy table of them: file, docs, ids, bytes."""
    path, folder = path or public_tokenizers.path(VOCABULARY), _uri(folder)

    def encode_to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer, sink = library_encoder(path), struct.pack("<I", end_id), None, None
        fs, base = _open(folder)
        for batch in batches:
            for part, k, t in zip(batch["part"], batch["key"], batch["text"].cast(pa.binary())):
                if writer is None:
                    name = f"part-{part.as_py():06d}-{uuid.uuid4().hex}.eft"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = FileWriter(sink)
                k = k.as_py()
                writer.add(NULL_KEY if k is None else k, np.frombuffer(encoder.encode(t.as_py()) + end, dtype="<u4"))
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": [len(writer.keys)], "ids": [writer.n], "bytes": [size]})

    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [F.col("key").asc_nulls_first(), F.col("hash")]
    # The tie tells repeated rows apart, so that they need not meet in one partition; they are alike, so any order will do.
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(docs.sparkSession), *order, "tie").sortWithinPartitions(*order, "tie")
    return dealt.select(F.spark_partition_id().alias("part"), "key", "text").mapInArrow(encode_to_file, "file string, docs long, ids long, bytes long")


def read(files: DataFrame, folder: str) -> DataFrame:
    """files: the table that `write` gives. One row per document: doc_id, start among all ids, ids."""
    folder = _uri(folder)

    def documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as f:
                    rows: list = []
                    size = 0
                    for k, start, ids in FileReader(f).documents():
                        rows.append((None if k == NULL_KEY else k, row["before"] + start, ids.tobytes()))
                        size += len(rows[-1][2])
                        if size > 4_000_000:
                            yield _batch(rows)
                            rows, size = [], 0
                    yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        k, start, ids = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "ids"])

    # A row for each file: one task and a running sum over them are safe.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    return placed.repartition(shuffle_width(files.sparkSession), "file").mapInArrow(documents_of, "doc_id long, start long, ids binary")


def folder_for(spark: SparkSession) -> str:
    return scratch(spark, "token-files")
