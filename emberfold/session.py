"""A session: Spark with the settings that the engine's semantics need, tables, statements and a fixed clock."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from copy import copy
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dialect import DialectError, Reader, kind_of, tokens_of, translate
from .operators import dml
from .operators.logs import as_of
from .sources.shared import stored
from .sources.tables import TABLES, load_table
from .types import spark_type

#: ANSI arithmetic raises on overflow; the last of duplicate map keys wins.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.timeType.enabled": "true",
}
_CONSTRAINTS = ("PRIMARY", "NOT", "NULL", "DEFAULT", "UNIQUE", "INDEX", "REFERENCES")


class Session:
    """Wraps a SparkSession. `now` is the clock that NOW, CURRENT_DATE and the like read: one value for a session.

    Tables that statements make are views over DataFrames; a statement that changes one writes its new contents to the
    shared folder and registers them, so plans do not grow with the number of statements. Unique columns are kept in
    `keys`, by the table's name: each entry of "unique" has a name and its expressions.
    """

    def __init__(self, spark: SparkSession, now: datetime | None = None, configure: bool = True):
        self.spark, self.now = spark, now or datetime(2024, 1, 1)
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, dict] = {}
        self.foreign: list[dml.ForeignKey] = []
        self.indexes: dict[str, str] = {}
        self.migrations = dml.Migrations()
        if configure:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)

    def load_tables(self, folder: str, names: Sequence[str] = TABLES) -> dict[str, DataFrame]:
        """Read the named Parquet tables and register each as a view."""
        for name in names:
            self.register(name, load_table(self.spark, folder, name))
        return {name: self.tables[name] for name in names}

    def register(self, name: str, df: DataFrame) -> DataFrame:
        self.tables[name.lower()] = df
        df.createOrReplaceTempView(name)
        return df

    def show(self, tables: Mapping[str, DataFrame], hide: Iterable[str] = ()) -> None:
        """Let the names in SQL mean these tables."""
        for name in hide:
            self.spark.catalog.dropTempView(name)
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def fork(self) -> Session:
        """The same tables and constraints; statements of either do not touch the other."""
        out = Session(self.spark, self.now, configure=False)
        out.tables, out.foreign, out.indexes = dict(self.tables), list(self.foreign), dict(self.indexes)
        out.keys = {name: {kind: copy(had) for kind, had in keys.items()} for name, keys in self.keys.items()}
        out.migrations = copy(self.migrations)
        return out

    def adopt(self, other: Session, names: Iterable[str]) -> None:
        """Take over these tables of another session with their constraints; what it lacks goes."""
        names = set(names)
        for name in names:
            for mine, theirs in ((self.tables, other.tables), (self.keys, other.keys)):
                mine.pop(name, None)
                if name in theirs:
                    mine[name] = theirs[name]
        self.foreign = [k for k in self.foreign if k.child not in names] + [k for k in other.foreign if k.child in names]
        self.indexes = {i: t for i, t in self.indexes.items() if t not in names} | {i: t for i, t in other.indexes.items() if t in names}
        self.migrations.version = max(self.migrations.version, other.migrations.version)
        self.show({name: self.tables[name] for name in names if name in self.tables}, [name for name in names if name not in self.tables])

    def table(self, name: str) -> DataFrame:
        df = self.tables.get(name.lower())
        return self.spark.table(name) if df is None else df

    def _kinds(self, text: str) -> dict[str, str | None]:
        """Kinds of the columns of every table that the text names; a name with two kinds has none."""
        kinds: dict[str, str | None] = {}
        for word in {value.lower() for kind, value in tokens_of(text) if kind == "word"}:
            df = self.tables.get(word)
            if df is None and self.spark.catalog.tableExists(word):
                df = self.spark.table(word)
            for name, spark_kind in df.dtypes if df is not None else ():
                kind = kind_of(spark_kind)
                kinds[name.lower()] = kind if kinds.get(name.lower(), kind) == kind else None
        return kinds

    def sql(self, text: str, params: Sequence | Mapping | None = None) -> DataFrame:
        """A query in the engine's dialect; `?` takes positional parameters, `:name` named ones."""
        spark_sql = translate(text, self.now, self._kinds(text))
        return self.spark.sql(spark_sql, args=params) if params else self.spark.sql(spark_sql)

    query = sql

    def explain(self, text: str) -> str:
        """The formatted plan."""
        return "\n".join(r[0] for r in self.spark.sql("EXPLAIN FORMATTED " + translate(text, self.now, self._kinds(text))).collect())

    def count(self, table: str, where: str | None = None) -> int:
        return self.sql(f"SELECT COUNT(*) AS n FROM {table}" + (f" WHERE {where}" if where else "")).first()[0]

    def read_at(self, text: str, timestamp, logs: Mapping[str, tuple[DataFrame, str | Sequence[str], str, object]]) -> DataFrame:
        """A query over tables as they were: logs gives each table's changelog, key, transaction column and deletion test."""
        then = Session(self.spark, self.now, configure=False)
        for name, (log, key, txn, deleted) in logs.items():
            then.register(name, as_of(log, key, txn, timestamp, deleted))
        return then.sql(text)

    def migrate(self, version: int, *statements: str) -> bool:
        """Run the statements if no migration of this version or a later one has run."""
        return self.migrations.migrate(version, lambda: [self.execute(x) for x in statements])

    # Calls of a client
    def create_table(self, name: str, columns: str) -> DataFrame:
        return self.execute(f"CREATE TABLE {name} ({columns})")

    def drop_table(self, name: str) -> None:
        self.execute(f"DROP TABLE {name}")

    def insert(self, name: str, rows: Sequence[tuple], columns: Sequence[str] | None = None) -> DataFrame:
        table = self.table(name)
        given = list(columns or table.columns)
        kinds = T.StructType([T.StructField(c, table.schema[c].dataType) for c in given])
        return self._changed(name, dml.insert(table, self.spark.createDataFrame(list(rows), kinds), given, self.keys.get(name.lower(), {}).get("defaults", {})))

    def update(self, name: str, changes: str, where: str | None = None) -> DataFrame:
        return self.execute(f"UPDATE {name} SET {changes}" + (f" WHERE {where}" if where else ""))

    def delete(self, name: str, where: str | None = None) -> DataFrame:
        return self.execute(f"DELETE FROM {name}" + (f" WHERE {where}" if where else ""))

    def select(self, name: str, columns: str = "*", where: str | None = None) -> DataFrame:
        return self.sql(f"SELECT {columns} FROM {name}" + (f" WHERE {where}" if where else ""))

    @staticmethod
    def single_value(df: DataFrame):
        row = df.first()
        return row[0] if row else None

    @staticmethod
    def column_values(df: DataFrame, column: str) -> list:
        return [r[0] for r in df.select(column).collect()]

    def current_timestamp(self):
        return F.lit(self.now).cast("timestamp_ntz")

    def current_date(self):
        return F.lit(self.now.date())

    def current_time_micros(self):
        """Microseconds of the day; Spark's TIME takes no interval arithmetic."""
        t = self.now
        return F.lit(((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond)

    # Statements
    def execute(self, text: str) -> DataFrame | None:
        """Any statement: a query gives its rows, one that changes a table gives the table's new contents."""
        r = Reader(text, self.now, self._kinds(text))
        if r.peek() in ("SELECT", "VALUES", "EXPLAIN"):
            return self.sql(text)
        if r.take("CREATE", "TABLE"):
            return self._create(r)
        if r.take("DROP", "TABLE"):
            return self._drop(r)
        if r.take("CREATE", "INDEX") or r.take("CREATE", "UNIQUE", "INDEX"):
            return self._index(r, text)
        if r.take("DROP", "INDEX"):
            quiet, name = r.take("IF", "EXISTS"), r.name().lower()
            if self.indexes.pop(name, None) is None and not quiet:
                raise DialectError(f"no index {name}")
            for keys in self.keys.values():
                keys["unique"] = [u for u in keys.get("unique", ()) if u[0] != name]
            return None
        if r.take("INSERT", "INTO"):
            return self._insert(r)
        if r.take("UPDATE"):
            name = r.name()
            r.need("SET")
            changes: dict[str, object] = {}
            while True:
                column = r.name()
                r.need("=")
                changes[column] = self.keys.get(name.lower(), {}).get("defaults", {}).get(column) if r.take("DEFAULT") else F.expr(r.expression()[0])
                if not r.take(","):
                    break
            where = F.expr(r.condition()) if r.take("WHERE") else None
            return self._changed(name, dml.update(self.table(name), changes, where))
        if r.take("DELETE", "FROM"):
            name = r.name()
            where = F.expr(r.condition()) if r.take("WHERE") else F.lit(True)
            if not any(k.parent == name.lower() for k in self.foreign):
                return self._changed(name, dml.delete(self.table(name), where))
            defaults = {f"{t}.{c}": v for t, k in self.keys.items() for c, v in k.get("defaults", {}).items()}
            for table, df in dml.delete_with_keys(self.tables, name.lower(), where, self.foreign, defaults).items():
                if df is not self.tables.get(table):
                    self.register(table, stored(df))
            return self.table(name)
        if r.take("ALTER", "TABLE"):
            return self._alter(r)
        raise DialectError(f"unknown statement {r.peek()!r}")

    def _create(self, r: Reader) -> DataFrame:
        quiet, name = r.take("IF", "NOT", "EXISTS"), r.name()
        if name.lower() in self.tables:
            if quiet:
                return self.tables[name.lower()]
            raise DialectError(f"table {name} is there already")
        if r.take("AS"):
            return self.register(name, stored(self.spark.sql(r.select())))
        fields, keys, foreign = [], {"unique": [], "required": [], "defaults": {}, "primary": []}, []
        if r.take("("):
            while not r.take(")"):
                if fields:
                    r.need(",")
                if self._table_constraint(r, name, keys, foreign):
                    continue
                column, kind, depth = r.name(), [], 0
                while not (depth == 0 and (r.peek() in (",", ")") or r.peek() in _CONSTRAINTS)):
                    token = r.next()
                    depth += (token == "(") - (token == ")")
                    kind.append(token)
                spelled = " ".join(kind).replace(" [", "[").replace("[ ", "[").replace(" ]", "]").replace("( ", "(").replace(" (", "(").replace(" )", ")")
                fields.append(T.StructField(column, spark_type(spelled)))
                self._constraints(r, name, column, keys, foreign)
        known = {f.name for f in fields}
        for column in [*keys["required"], *(c for _, columns in keys["unique"] for c in columns), *(k.column for k in foreign)]:
            if column not in known:
                raise DialectError(f"no column {column} in {name}")
        for k in foreign:
            primary = keys["primary"] if k.parent == name.lower() else self.keys.get(k.parent, {}).get("primary", [])
            if k.parent not in self.tables and k.parent != name.lower():
                raise DialectError(f"no table {k.parent} to refer to")
            if primary != [k.key]:
                raise DialectError(f"{k.parent}.{k.key} is not the primary key")
        self.foreign += foreign
        self.keys[name.lower()] = keys
        return self.register(name, self.spark.createDataFrame([], T.StructType(fields)))

    @staticmethod
    def _names(r: Reader) -> list[str]:
        r.need("(")
        out = [r.name()]
        while r.take(","):
            out.append(r.name())
        r.need(")")
        return out

    @staticmethod
    def _primary(columns: list[str], keys: dict) -> None:
        if keys["primary"]:
            raise DialectError("a table has one primary key")
        keys["primary"] = columns
        keys["unique"].append(("", columns))
        keys["required"] += columns

    def _reference(self, r: Reader, table: str, column: str, foreign: list) -> None:
        parent, key, action = r.name(), self._names(r), "NO ACTION"
        if len(key) != 1:
            raise DialectError("a foreign key refers to one column")
        while r.take("ON"):
            deletes = r.take("DELETE")
            if not deletes:
                r.need("UPDATE")
            said = " ".join([r.next().upper()] + ([r.next().upper()] if r.peek() in ("ACTION", "NULL", "DEFAULT") else []))
            action = said if deletes else action
        foreign.append(dml.ForeignKey(table.lower(), column, parent.lower(), key[0], action))

    def _table_constraint(self, r: Reader, table: str, keys: dict, foreign: list) -> bool:
        """PRIMARY KEY, UNIQUE or FOREIGN KEY over columns, by itself."""
        named = r.peek() == "CONSTRAINT" and r.peek(2) in ("PRIMARY", "UNIQUE", "FOREIGN")
        if named:
            r.next()
            r.name()
        if r.take("PRIMARY", "KEY"):
            self._primary(self._names(r), keys)
        elif r.peek() == "UNIQUE" and r.peek(1) == "(" and r.take("UNIQUE"):
            keys["unique"].append(("", self._names(r)))
        elif r.take("FOREIGN", "KEY"):
            columns = self._names(r)
            r.need("REFERENCES")
            if len(columns) != 1:
                raise DialectError("a foreign key has one column")
            self._reference(r, table, columns[0], foreign)
        else:
            return False
        return True

    def _drop(self, r: Reader) -> None:
        """One table or some; a table that others refer to goes with CASCADE only, and so do their foreign keys."""
        quiet, names = r.take("IF", "EXISTS"), [r.name()]
        while r.take(","):
            names.append(r.name())
        gone, cascade = {n.lower() for n in names}, r.take("CASCADE")
        r.take("RESTRICT")
        for name in names:
            if name.lower() not in self.tables and not quiet:
                raise DialectError(f"no table {name}")
            child = next((k.child for k in self.foreign if k.parent == name.lower() and k.child not in gone), None)
            if child and not cascade:
                raise dml.ConstraintError(f"{child} refers to {name}")
        self.foreign = [k for k in self.foreign if k.parent not in gone and k.child not in gone]
        for name in names:
            self.tables.pop(name.lower(), None)
            self.keys.pop(name.lower(), None)
            self.indexes = {i: t for i, t in self.indexes.items() if t != name.lower()}
            self.spark.catalog.dropTempView(name)

    def _index(self, r: Reader, text: str) -> None:
        """Layouts and Parquet statistics do an index's work; a unique one is a constraint from now on."""
        unique = text.split()[1].upper() == "UNIQUE"
        r.take("IF", "NOT", "EXISTS")
        index = r.name().lower()
        r.need("ON")
        name = r.name().lower()
        if name not in self.tables:
            raise DialectError(f"no table {name}")
        if index in self.indexes:
            raise DialectError(f"index {index} is there already")
        r.need("(")
        parts = [r.expression()[0]]
        while r.take(","):
            parts.append(r.expression()[0])
        r.need(")")
        if unique:
            dml.check(dml.unique_violations(self.tables[name], parts), f"{name}: a value twice in {index}")
            self.keys.setdefault(name, {}).setdefault("unique", []).append((index, parts))
        self.indexes[index] = name

    def _constraints(self, r: Reader, table: str, column: str, keys: dict, foreign: list) -> None:
        while r.peek() in _CONSTRAINTS:
            if r.take("PRIMARY", "KEY"):
                self._primary([column], keys)
            elif r.take("NOT", "NULL"):
                keys["required"].append(column)
            elif r.take("UNIQUE"):
                keys["unique"].append(("", [column]))
            elif r.take("DEFAULT"):
                keys["defaults"][column] = F.expr(r.expression()[0])
            elif r.take("REFERENCES"):
                self._reference(r, table, column, foreign)
            elif not r.take("NULL"):
                r.need("INDEX")

    def _insert(self, r: Reader) -> DataFrame:
        name = r.name()
        table, defaults, columns = self.table(name), self.keys.get(name.lower(), {}).get("defaults", {}), None
        if r.take("DEFAULT", "VALUES"):
            return self._changed(name, dml.insert_defaults(table, defaults))
        if r.peek() == "(" and r.peek(1) not in ("SELECT", "VALUES"):
            r.need("(")
            columns = [r.name()]
            while r.take(","):
                columns.append(r.name())
            r.need(")")
        return self._changed(name, dml.insert(table, self.spark.sql(r.select()), columns, defaults))

    def _changed(self, name: str, df: DataFrame) -> DataFrame:
        """Check the table's constraints on its new contents, then register them."""
        keys, df = self.keys.get(name.lower(), {}), stored(df)
        if keys.get("required"):
            dml.check(dml.null_violations(df, keys["required"]), f"{name}: null in a column that takes none")
        for _, columns in keys.get("unique", ()):
            dml.check(dml.unique_violations(df, columns), f"{name}({', '.join(columns)}): a value twice")
        for k in self.foreign:
            if k.child == name.lower():
                dml.check(dml.orphans(df, k.column, self.table(k.parent), k.key), f"{name}.{k.column}: no such {k.parent}")
        return self.register(name, df)

    def _alter(self, r: Reader) -> DataFrame:
        name = r.name()
        table = self.table(name)
        if r.take("RENAME", "TO"):
            new = r.name()
            self.tables.pop(name.lower(), None)
            self.spark.catalog.dropTempView(name)
            self.keys[new.lower()] = self.keys.pop(name.lower(), {})
            return self.register(new, table)
        if r.take("RENAME", "COLUMN"):
            old = r.name()
            r.need("TO")
            return self.register(name, dml.rename_column(table, old, r.name()))
        if r.take("DROP", "COLUMN"):
            return self.register(name, dml.drop_column(table, r.name()))
        r.need("ADD")
        r.take("COLUMN")
        column, kind = r.name(), []
        while r.peek() and r.peek() not in (*_CONSTRAINTS, ";"):
            kind.append(r.next())
        default = F.expr(r.expression()[0]) if r.take("DEFAULT") else None
        return self.register(name, dml.add_column(table, column, spark_type(" ".join(kind)).simpleString(), default))
