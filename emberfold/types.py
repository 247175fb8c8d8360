"""The engine's type names and the Spark types that hold them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import column, fail
from .functions.numbers import unsigned

# The spellings of scalar types.
SCALARS = {
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "HUGEINT": T.DecimalType(38, 0),
    "TINYINT UNSIGNED": T.ShortType(), "SMALLINT UNSIGNED": T.IntegerType(), "INT UNSIGNED": T.LongType(), "INTEGER UNSIGNED": T.LongType(), "BIGINT UNSIGNED": T.DecimalType(20, 0), "HUGEINT UNSIGNED": T.DecimalType(38, 0),
    "REAL": T.FloatType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "DOUBLE PRECISION": T.DoubleType(), "DECIMAL": T.DecimalType(38, 10),
    "STRING": T.StringType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(),
    "DATE": T.DateType(), "TIME": T.LongType(), "TIMESTAMP": T.TimestampNTZType(),
    "UUID": T.StringType(), "BYTEA": T.BinaryType(), "BLOB": T.BinaryType(), "INET": T.StringType(), "JSON": T.VariantType(),
    "INTERVAL": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]),
    "POINT": T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]),
    "PRIVATE KEY": T.StringType(), "PUBLIC KEY": T.StringType(), "IDENTITY": T.StringType(), "VAULT": T.StringType(),
}
UNSIGNED_BITS = {"TINYINT UNSIGNED": 8, "SMALLINT UNSIGNED": 16, "INT UNSIGNED": 32, "INTEGER UNSIGNED": 32, "BIGINT UNSIGNED": 64, "HUGEINT UNSIGNED": 128}

_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_BYTE}(\.{_BYTE}){{3}}"
_GROUP = "[0-9a-f]{1,4}"
#: Eight groups, or fewer with one "::"; the last two may be spelled as four bytes.
_V6 = rf"({_GROUP}:){{7}}{_GROUP}|({_GROUP}:){{6}}{_V4}|(?!.*::.*::)(?=.*::)(?!(.*?{_GROUP}(:|$)){{8}})({_GROUP})?(::?{_GROUP})*(::|::?{_V4})?"
ADDRESS = rf"(?i)^({_V4}|{_V6})$"
UUID_MARKS, UUID_DIGITS = "[-{}]", "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$"


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth = [""], 0
    for c in text:
        depth += (c in "([") - (c in ")]")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type's spelling, nested ones included: INT[], INT[3], MAP(VARCHAR, INT), STRUCT(a INT, b TEXT)."""
    name = " ".join(name.split())
    if array := re.fullmatch(r"(.+)\[\d*\]", name):
        return T.ArrayType(spark_type(array[1]))
    if nested := re.fullmatch(r"(?i)(MAP|STRUCT)\s*\((.*)\)", name):
        parts = _split(nested[2])
        if nested[1].upper() == "MAP":
            return T.MapType(T.StringType(), spark_type(parts[1]))
        return T.StructType([T.StructField(f, spark_type(t)) for f, _, t in (p.partition(" ") for p in parts)])
    return SCALARS[name.upper()]


def cast(x, name: str) -> Column:
    """CAST(x AS name): out of range is an error; floats lose their fraction toward zero; UUIDs are checked."""
    x, upper = column(x), " ".join(name.upper().split())
    if upper in UNSIGNED_BITS:
        return unsigned(x, UNSIGNED_BITS[upper])
    if upper == "UUID":
        plain = F.lower(F.regexp_replace(x, UUID_MARKS, ""))
        return F.when(x.isNull() | plain.rlike(UUID_DIGITS), F.regexp_replace(plain, UUID_DIGITS, "$1-$2-$3-$4-$5")).otherwise(fail("not a UUID"))
    if upper == "INET":
        return F.when(x.isNull() | x.rlike(ADDRESS), F.lower(x)).otherwise(fail("not an address"))
    if upper == "JSON":
        return F.parse_json(x)
    if length := re.fullmatch(r".+\[(\d+)\]", upper):
        out = x.cast(spark_type(name))
        return F.when(x.isNull() | (F.size(x) == int(length[1])), out).otherwise(F.from_json(fail("wrong array length"), spark_type(name)))
    return x.cast(spark_type(name))


def checked_text(x: str, name: str) -> str | None:
    """The same for UUID and INET in Spark's SQL; None for other types."""
    text = f"CAST({x} AS STRING)"
    if name.upper() == "UUID":
        plain = f"lower(regexp_replace({text}, r'{UUID_MARKS}', ''))"
        return f"CASE WHEN {plain} RLIKE r'{UUID_DIGITS}' THEN regexp_replace({plain}, r'{UUID_DIGITS}', '$1-$2-$3-$4-$5') WHEN {text} IS NOT NULL THEN CAST(raise_error('not a UUID') AS STRING) END"
    if name.upper() == "INET":
        return f"CASE WHEN {text} RLIKE r'{ADDRESS}' THEN lower({text}) WHEN {text} IS NOT NULL THEN CAST(raise_error('not an address') AS STRING) END"
    return None
