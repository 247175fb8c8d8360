"""Running values along an order, dealt out by (key, block) so that no key's rows meet in one task.

The order's column is cut into blocks at approximate quantiles, one for each shuffle partition. A window runs inside a
(key, block); what the blocks before hand on is a row for each of them, joined back by the same key. Rows are shuffled
once, as by a plain window, but a key that holds a third of all rows, or the only key there is, is split.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def with_blocks(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Add the number of the row's block: it rises with the order's column, which must cast to double.

    Rows that have their blocks keep them, so that running values along one order find the quantiles once.
    """
    if BLOCK in df.columns:
        return df
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 1000)).first()[0] if n > 1 else None  # n - 1 numbers
    return df.withColumn(BLOCK, _block(at, sorted(set(cuts or ()))))


def _block(at: Column, edges: list[float]) -> Column:
    """How many edges are less: first which group of them, then within it, so a row meets about 2 * sqrt(n) of n edges.

    A null comes last, as in `_place`.
    """
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges) - 1) + 1
    groups = [[float(x) for x in edges[i : i + step]] for i in range(0, len(edges), step)]
    less = lambda xs: F.size(F.filter(xs, lambda e: e < at))
    before = less(F.lit([g[0] for g in groups]))
    return F.when(at.isNull(), len(edges)).when(before == 0, 0).otherwise((before - 1) * step + less(F.element_at(F.array(*map(F.lit, groups)), before)))


def _place(order: str) -> Column:
    return F.asc_nulls_last(order)


def _handed_on(rows: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    return rows.groupBy(*keys, BLOCK).agg(*(v.alias(name) for name, v in values.items()))


def _join(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = carried.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, BLOCK])), *(c for c in carried.columns if c not in (*keys, BLOCK)))
    on = F.lit(True)
    for i, c in enumerate([*keys, BLOCK]):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(renamed, on).drop(*(f"__k{i}" for i in range(len(keys) + 1)))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, step: Column, name: str, low: str | None = None, blocks: int | None = None, peers: bool = False, **also: Column) -> DataFrame:
    """Add the sum of `step` up to each row, and with `low` its least value so far, and before the row as `low`_before.

    All count an empty start as 0. `also` names further columns to sum along. Rows of one key with equal places in the order
    are in any order, or with `peers` each has the sum up to the last of them; that is not for `low`.
    """
    steps = {name: step, **also}
    rows = with_blocks(df, order, blocks).withColumns({f"__one_{n}": c for n, c in steps.items()})
    upto = Window.partitionBy(*keys, BLOCK).orderBy(_place(order))
    upto = (upto.rangeBetween if peers else upto.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__in_{n}": F.sum(f"__one_{n}").over(upto) for n in steps})
    between = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    zero, local = F.lit(0), f"__in_{name}"
    totals = {f"__total_{n}": F.sum(f"__one_{n}") for n in steps}
    carried = _handed_on(rows, keys, __least=F.min(local), **totals).withColumns({f"__start_{n}": F.coalesce(F.sum(f"__total_{n}").over(between), zero) for n in steps})
    start = F.col(f"__start_{name}")
    carried = carried.withColumn("__floor", F.least(zero, F.coalesce(F.min(start + F.col("__least")).over(between), zero)))
    rows = _join(rows, carried.drop("__least", *totals), keys)
    if low:
        before = Window.partitionBy(*keys, BLOCK).orderBy(_place(order)).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn(low, F.least("__floor", start + F.min(local).over(upto)))
        rows = rows.withColumn(f"{low}_before", F.least("__floor", F.coalesce(start + F.min(local).over(before), F.col("__floor"))))
    rows = rows.withColumns({n: F.col(f"__start_{n}") + F.col(f"__in_{n}") for n in steps})
    made = [f"__{part}_{n}" for n in steps for part in ("one", "in", "start")]
    return rows.drop(*made, "__floor", *({BLOCK} - set(df.columns)))


def previous(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], blocks: int | None = None) -> DataFrame:
    """Add what each value was in the row before, by key; null in the first."""
    rows = with_blocks(df, order, blocks).withColumn("__now", F.struct(*(v.alias(n) for n, v in values.items())))
    within = Window.partitionBy(*keys, BLOCK).orderBy(_place(order))
    between = Window.partitionBy(*keys).orderBy(BLOCK)
    rows = rows.withColumn("__lag", F.lag("__now").over(within))
    carried = _handed_on(rows, keys, __last=F.max_by("__now", F.struct(F.col(order).isNull(), order))).withColumn("__carried", F.lag("__last").over(between)).drop("__last")
    rows = _join(rows, carried, keys).withColumn("__lag", F.coalesce("__lag", "__carried"))
    return rows.select(*df.columns, *(F.col(f"__lag.{n}").alias(n) for n in values))
