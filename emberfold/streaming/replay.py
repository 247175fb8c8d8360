"""Replay of a log through Structured Streaming: batches in order, each written once under its number.

A batch that runs again after a failure overwrites its own folder, so a replay is exactly-once. State is a fold over the
folders, by the operators of emberfold.operators.logs; a reader at any time sees a prefix of the log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replay(spark: SparkSession, path: str, schema: StructType, folder: str, files_per_batch: int = 1, keep: Column | None = None) -> DataFrame:
    """Read what is there now, batch by batch, from where the folder's checkpoint stands; the log that has been replayed.

    keep drops messages past their deadline.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    stream = stream if keep is None else stream.where(keep)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/log/epoch={epoch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/log")


def replayed_state(spark: SparkSession, path: str, schema: StructType, folder: str, fold: Callable[[DataFrame], DataFrame], **options) -> DataFrame:
    return fold(replay(spark, path, schema, folder, **options))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped. An extension of the log's operators."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
