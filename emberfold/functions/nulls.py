"""Functions about null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fail, value


def coalesce(*xs) -> Column:
    return F.coalesce(*map(value, xs))


def ifnull(a, b) -> Column:
    return F.coalesce(value(a), value(b))


def nullif(a, b) -> Column:
    return F.nullif(value(a), value(b))


def _strict(name: str, pick, xs, kind: str) -> Column:
    xs = [value(x) for x in xs]
    if len(xs) < 2:
        raise ValueError(f"{name} takes two arguments or more")
    missing = xs[0].isNull()
    for x in xs[1:]:
        missing = missing | x.isNull()
    return F.when(missing, fail(f"{name} takes no null", kind)).otherwise(pick(*xs))


def greatest(*xs, kind: str = "double") -> Column:
    """A null argument is an error. kind is the type of the arguments."""
    return _strict("GREATEST", F.greatest, xs, kind)


def least(*xs, kind: str = "double") -> Column:
    return _strict("LEAST", F.least, xs, kind)
