"""INSERT, UPDATE and DELETE as transforms from table to table, with their constraints.

Parquet has no row updates: a statement gives the new contents, which the caller writes. Checks are queries whose rows
are the violations; `check` raises if there is one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import value


class ConstraintError(ValueError):
    """A row breaks a constraint."""


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str
    on_delete: str = "NO ACTION"


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of columns or expressions that occur twice; a null is no value."""
    present = F.lit(True)
    for c in columns:
        present = present & F.expr(c).isNotNull()
    return df.where(present).groupBy(*map(F.expr, columns)).agg(F.count("*").alias("n")).where("n > 1")


def null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return df.where(missing)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose foreign key is not null and has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__key")), F.col(column) == F.col("__key"), "left_anti")


def check(violations: DataFrame, message: str) -> None:
    if not violations.isEmpty():
        raise ConstraintError(f"{message}: {violations.first()}")


def insert(table: DataFrame, rows: DataFrame, columns: Sequence[str] | None = None, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Append rows: columns that are not given take their default, or null; types are those of the table."""
    columns, defaults = list(columns or table.columns), defaults or {}
    if len(columns) != len(rows.columns):
        raise ValueError(f"INSERT has {len(rows.columns)} values for {len(columns)} columns")
    given = rows.toDF(*columns)
    fitted = [(F.col(f.name) if f.name in columns else value(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in table.schema]
    return table.unionByName(given.select(*fitted))


def insert_defaults(table: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    row = table.sparkSession.range(1).select(*(value(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema))
    return table.unionByName(row)


def update(table: DataFrame, changes: Mapping[str, object], where: Column | None = None) -> DataFrame:
    """Every expression reads the old row. A condition that is null changes nothing."""
    hit = F.lit(True) if where is None else where
    return table.select(*(F.when(hit, value(changes[f.name]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema))


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    """What stays: rows whose condition is false or null."""
    return table.where(F.lit(False)) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def delete_with_keys(tables: Mapping[str, DataFrame], name: str, where: Column, keys: Sequence[ForeignKey], defaults: Mapping[str, object] | None = None) -> dict[str, DataFrame]:
    """Delete and carry out what foreign keys ask for, through any number of tables; a cycle of them is an error."""
    out = dict(tables)
    _delete(out, name, tables[name].where(where), keys, defaults or {}, ())
    return out


def _delete(tables: dict[str, DataFrame], name: str, gone: DataFrame, keys: Sequence[ForeignKey], defaults: Mapping[str, object], path: tuple) -> None:
    if name in path:
        raise ConstraintError(f"foreign keys lead back to {name}")
    before = tables[name]
    for k in (k for k in keys if k.parent == name):
        dead = gone.select(F.col(k.key).alias("__key")).distinct()
        child, match = tables[k.child], F.col(k.column) == F.col("__key")
        hit, rest = child.join(dead, match, "left_semi"), child.join(dead, match, "left_anti")
        action = k.on_delete.upper()
        if action in ("NO ACTION", "RESTRICT"):
            check(hit, f"{k.child}.{k.column} refers to {name}")
        elif action == "CASCADE":
            _delete(tables, k.child, hit, keys, defaults, (*path, name))
        elif action in ("SET NULL", "SET DEFAULT"):
            new = None if action == "SET NULL" else defaults.get(f"{k.child}.{k.column}")
            tables[k.child] = rest.unionByName(hit.withColumn(k.column, value(new).cast(child.schema[k.column].dataType)))
        else:
            raise ValueError(f"unknown action {k.on_delete}")
    # Rows are told apart by all their columns; equal rows go together, as the condition took all of them.
    on = F.lit(True)
    left, right = before.alias("l"), gone.distinct().alias("r")
    for c in before.columns:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    tables[name] = left.join(right, on, "left_anti")


def add_column(table: DataFrame, name: str, kind: str, default: object = None) -> DataFrame:
    if name in table.columns:
        raise ValueError(f"column {name} is there already")
    return table.withColumn(name, value(default).cast(kind))


def drop_column(table: DataFrame, name: str) -> DataFrame:
    if name not in table.columns:
        raise ValueError(f"no column {name}")
    return table.drop(name)


def rename_column(table: DataFrame, old: str, new: str) -> DataFrame:
    if old not in table.columns or new in table.columns:
        raise ValueError(f"cannot rename {old} to {new}")
    return table.withColumnRenamed(old, new)


class Migrations:
    """Runs each version's statements once, in rising order."""

    def __init__(self, done: int = 0):
        self.version = done

    def migrate(self, version: int, run) -> bool:
        if version <= self.version:
            return False
        run()
        self.version = version
        return True
