"""The aggregates, and the two of them that Spark's own do not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import column


def count(x="*") -> Column:
    return F.count("*" if isinstance(x, str) and x == "*" else column(x))


def count_distinct(x) -> Column:
    return F.count_distinct(column(x))


def count_distinct_rows(df: DataFrame) -> Column:
    """COUNT(DISTINCT *): rows that hold a null count as well."""
    return F.count_distinct(F.struct(*(F.col(c) for c in df.columns)))


def sum_(x, kind: str | None = None) -> Column:
    """kind keeps the input's type, with an error on overflow."""
    total = F.sum(column(x))
    return total.cast(kind) if kind else total


def sum_distinct(x) -> Column:
    return F.sum_distinct(column(x))


def avg(x, exact: bool = False) -> Column:
    """exact: as a decimal."""
    return F.avg(column(x).cast("decimal(38,10)") if exact else column(x))


def avg_distinct(x) -> Column:
    return F.sum_distinct(column(x)) / F.count_distinct(column(x))


def minimum(x) -> Column:
    return F.min(column(x))


def maximum(x) -> Column:
    return F.max(column(x))


def stdev(x) -> Column:
    """Of a sample; null for one row or none."""
    return F.stddev_samp(column(x))


def variance(x) -> Column:
    return F.var_samp(column(x))


def distinct_then(df: DataFrame, keys: list[str], x: str, **aggregates: Column) -> DataFrame:
    """Aggregates of the distinct values of x by key, in two steps that both combine before their shuffle.

    STDEV(DISTINCT x) and VARIANCE(DISTINCT x) take this form, as no group's values are ever gathered in one row.
    """
    return df.select(*keys, x).distinct().groupBy(*keys).agg(*(c.alias(name) for name, c in aggregates.items()))


def array_agg(x) -> Column:
    """Keeps nulls."""
    return F.transform(F.collect_list(F.struct(column(x).alias("x"))), lambda s: s["x"])
