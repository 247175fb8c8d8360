"""Relational operators whose rules differ from Spark's defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import column


def ordering(key: str | int | Column | tuple, df: DataFrame | None = None) -> Column:
    """One sort key: nulls last ascending, first descending. A tuple is (key, "ASC" or "DESC"), a number an ordinal from 1."""
    key, way = key if isinstance(key, tuple) else (key, "ASC")
    if isinstance(key, int):
        if df is None or not 1 <= key <= len(df.columns):
            raise ValueError(f"ORDER BY position {key} is not in the select list")
        key = df.columns[key - 1]
    c = column(key)
    return c.desc_nulls_first() if way.upper() == "DESC" else c.asc_nulls_last()


def order_by(df: DataFrame, *keys) -> DataFrame:
    return df.orderBy(*(ordering(k, df) for k in keys))


def limit_offset(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The offset comes first, whatever the order of the clauses."""
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("LIMIT and OFFSET take 0 or more")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


#: Parts that a key's rows are dealt into before its first row is chosen.
SALTS = 64


def distinct_on(df: DataFrame, keys: Sequence, order: Sequence) -> DataFrame:
    """The first row of each key in the order given.

    Where every key of the order is ascending, a grouped minimum over (order, row), which combines before its shuffle.
    Otherwise ranks in two steps, first within (key, salt), so that a key with a third of all rows is dealt over many tasks.
    """
    if all(isinstance(k, str) for k in order):
        # In a struct null sorts first; the flag puts it last.
        ranks = [x for k in order for x in (F.col(k).isNull(), F.col(k))]
        row = F.struct(*(F.col(c) for c in df.columns))
        return df.groupBy(*map(column, keys)).agg(F.min_by(row, F.struct(*ranks)).alias("__row")).select("__row.*")
    by, ranked = list(map(column, keys)), [ordering(k, df) for k in order]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*(F.col(c) for c in df.columns)), F.lit(SALTS)))
    firsts = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*ranked))).where("__rank = 1")
    return firsts.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*ranked))).where("__rank = 1").drop("__rank", "__salt")


def join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner") -> DataFrame:
    """INNER, LEFT, RIGHT, FULL with any condition; a condition that is null does not match. CROSS takes none."""
    if how.lower() == "cross":
        if on is not None:
            raise ValueError("CROSS JOIN takes no condition")
        return left.crossJoin(right)
    if on is None:
        raise ValueError("a join takes a condition, or CROSS")
    return left.join(right, on, {"left": "left_outer", "right": "right_outer", "full": "full_outer"}.get(how.lower(), how.lower()))


def unnest(df: DataFrame, array, name: str, outer: bool = False) -> DataFrame:
    """Lateral: a row for each element. An empty array gives none, or with `outer` one with null."""
    return df.withColumn(name, (F.explode_outer if outer else F.explode)(column(array)))


def semi(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """EXISTS."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """x NOT IN (subquery) with three values: a null on the right keeps nothing; a null on the left stays only if the right is empty."""
    facts = right.agg(F.count("*").alias("__n"), F.count_if(F.col(right_key).isNull()).alias("__nulls"))  # one row
    kept = left.join(right.select(F.col(right_key).alias("__k")).where("__k is not null").distinct(), F.col(left_key) == F.col("__k"), "left_anti")
    # One row beside every row: a broadcast of two numbers.
    kept = kept.join(F.broadcast(facts), how="cross")
    return kept.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(left_key).isNotNull())).drop("__n", "__nulls")
