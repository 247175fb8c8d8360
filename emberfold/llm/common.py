"""Pieces that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import scratch, shared_dir

#: White space of the word rule: fixed by the contracts.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str | Column = "text") -> Column:
    """The text, '' where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bucket_of(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo; null keys fall in the bucket of the text ''."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: one evaluation, and a lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch.
BATCH_BYTES = 4_000_000
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for a context, however the session was started.

    Batches to and from Python are bounded by their bytes, unless the session asks for less: whole texts may be long.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_emberfold_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="emberfold-")) / "emberfold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._emberfold_shipped = True


def release_memory() -> None:
    """Hand freed memory back to the system: a worker process is kept between tasks, and should hold no more than it uses."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


#: Bytes of texts that `with_computed` hands over at a time, so that what is computed from them stays small.
SLICE_BYTES = 1_000_000


def by_bytes(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of a column's texts, '' for null, up to so many bytes each (one text at least), with the place of the first."""
    first, some, size = 0, [], 0
    for place, text in enumerate(texts):
        some.append(text.as_py() or "")
        size += len(some[-1])
        if size >= most:
            yield first, some
            first, some, size = place + 1, [], 0
    if some:
        yield first, some


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def with_computed(docs: DataFrame, name: str, kind: str, compute: Callable[[list[str]], pa.Array], text: str | Column = "text", keep: list[str] | None = None) -> DataFrame:
    """Add a column that Python computes from whole texts, some of them at a time by their bytes rather than by rows.

    keep: the columns to return beside it, all by default. Only they and the text go to Python, each once.
    """
    kept = docs.columns if keep is None else keep
    beside = isinstance(text, str) and text in kept
    sent = [quoted(c) for c in kept] + ([] if beside else [(F.col(text) if isinstance(text, str) else text).alias("__ef_text")])
    slim = docs.select(*sent)
    schema = T.StructType([*slim.schema.fields[: len(kept)], *T.StructType.fromDDL(f"`{name}` {kind}").fields])
    text_at, n = kept.index(text) if beside else len(kept), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in by_bytes(batch.column(text_at), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(some)).columns[:n], compute(some)], names=schema.names)
        release_memory()

    return slim.mapInArrow(run, schema)


#: A key with over one of so many parts of all rows is joined by broadcast: there are fewer such keys than this.
PARTS = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, count: str = "n") -> DataFrame:
    """Rows with the table's row of their key; rows without one go. No key meets in one task, however many rows it has.

    table: distinct keys, each with its number of rows in `count`, which is dropped. total: of the rows. Keys that have
    more than one of `PARTS` parts are broadcast, `PARTS` at most; the others are shuffled.
    """
    hot = F.col(count) * PARTS > total
    few = F.broadcast(table.where(hot).drop(count))
    rest = rows.join(F.broadcast(table.where(hot).select(*([key] if isinstance(key, str) else key))), key, "left_anti")
    return rows.join(few, key).union(rest.join(table.where(~hot).drop(count), key))


def picked(rows: DataFrame, numbers: DataFrame, column: str) -> DataFrame:
    """Rows whose number in `column` is among `numbers`, without a shuffle of the rows, which may be wide.

    The numbers go to every task as bits, 64 to a word: half a byte for each row of a table that is numbered throughout.
    """
    word, bit = F.shiftright(column, 6), F.col(column).bitwiseAND(63).cast("int")
    words = numbers.groupBy(word.alias("__ef_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__ef_bits"))
    # Written first: a broadcast that had to compute them would have only so much time.
    marked = rows.join(F.broadcast(cut(words)), word == F.col("__ef_word"))
    return marked.where(F.getbit("__ef_bits", bit) == 1).drop("__ef_word", "__ef_bits")


def written(df: DataFrame, name: str) -> DataFrame:
    """Like `cut`, for wide rows: a compressed Parquet table in the shared folder, of which later reads take what they need."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
