"""Column builders. Each is a composition of Spark's own functions, so plans stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x) -> Column:
    """A Column as it is, a name as that column."""
    return x if isinstance(x, Column) else F.col(x)


def value(x) -> Column:
    """A Column as it is, anything else as a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def fail(message: str, kind: str = "string") -> Column:
    """Raises when a row reaches it."""
    return F.raise_error(F.lit(message)).cast(kind)
