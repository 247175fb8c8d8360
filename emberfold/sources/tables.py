"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def series(spark: SparkSession, n: int) -> DataFrame:
    """1 to n, as a BIGINT column n; a negative n is an error."""
    if n < 0:
        raise ValueError("SERIES takes a number of rows of 0 or more")
    return spark.range(1, n + 1).toDF("n")


def one_row(spark: SparkSession) -> DataFrame:
    """What SELECT without FROM reads."""
    return series(spark, 1)


def values(spark: SparkSession, rows: list[tuple], types: str | T.StructType | None = None) -> DataFrame:
    """An inline table; columns are column1 to columnN. Without types, a column's is that of its values, widened."""
    names = [f"column{i + 1}" for i in range(len(rows[0]))] if rows else []
    if isinstance(types, str) and rows:
        types = ", ".join(f"{n} {t.strip()}" for n, t in zip(names, types.split(",")))
    return spark.createDataFrame(rows, types if types is not None else names)


def nothing(spark: SparkSession, schema: str = "") -> DataFrame:
    return spark.createDataFrame([], schema or T.StructType([]))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """CREATE TABLE AS to Parquet. Sorted within files, a later range or equality filter skips row groups, as an index would."""
    out = df.repartition(*partition_by) if partition_by else df
    if sort_by:
        out = out.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def index_scan(df: DataFrame, equal: dict | None = None, column: str | None = None, low=None, high=None, low_open: bool = False, high_open: bool = False) -> DataFrame:
    """Equality on leading columns, then a range; null keys drop. The predicates reach the Parquet reader."""
    for name, value in (equal or {}).items():
        df = df.where(F.col(name) == value)
    if column and low is not None:
        df = df.where(F.col(column) > low if low_open else F.col(column) >= low)
    if column and high is not None:
        df = df.where(F.col(column) < high if high_open else F.col(column) <= high)
    return df
