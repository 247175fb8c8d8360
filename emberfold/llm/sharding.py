"""Sharding by global byte-size prefix sums.

Native. Slim rows (key, size, checksum) are range-partitioned in document order and written once with their partition's
number. Each partition's totals, one row per partition, are turned into offsets by a running sum; a running sum inside a
partition plus its offset is the global prefix. A shard is where the middle of a document's span of bytes falls among
equal targets, so shards are contiguous in document order, gapless in slots, and their sizes differ from the target by
one document at most. Only slim rows are shuffled, never texts.

Defined results: a null text counts as '', 8 bytes with its header; a null doc_id comes first; documents with one doc_id
are in order of size and checksum, and rows alike in all three are interchangeable. An empty table gives no rows. With
fewer documents than shards, or one enormous document, some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_width, whole_text

SHARDS, HEADER_BYTES = 24, 8


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    whole = whole_text(text)
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(whole) + HEADER_BYTES).cast("long").alias("size"), F.crc32(whole.cast("binary")).cast("long").alias("text_crc32"))


def shard_by_bytes(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows: doc_id, size, text_crc32. Adds shard, slot and the global byte offset first_byte."""
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    # The last key only tells rows apart that are alike, so that no value of the others makes one partition too large.
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = cut(spread.repartitionByRange(shuffle_width(rows.sparkSession), *order, "tie").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each partition of the exchange above: a bounded table, so one task and a broadcast are safe.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    within = Window.partitionBy("part").orderBy(*order, "tie")
    numbered = (
        placed.withColumn("bytes_in", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row_in", F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("first_byte", F.col("bytes_before") + F.col("bytes_in"))
        .withColumn("row", F.col("rows_before") + F.col("row_in"))
    )
    # floor((first + size / 2) * shards / all), in whole numbers; decimals, as the product outgrows a long.
    middle = (F.col("first_byte").cast("decimal(24,0)") * 2 + F.col("size")) * shards
    numbered = numbered.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle / (F.col("all_bytes").cast("decimal(24,0)") * 2)).cast("int")))
    numbered = cut(numbered.select("doc_id", "size", "text_crc32", "first_byte", "row", "shard"))
    starts = numbered.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard at most
    return numbered.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "first_byte", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
