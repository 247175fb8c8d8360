"""Predicates with three values: true, false, null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, value


def equal_number(a, b) -> Column:
    """Equality of floating numbers where NaN equals nothing."""
    a, b = value(a), value(b)
    return (a == b) & ~F.isnan(a)


def xor(a: Column, b: Column) -> Column:
    return a != b


def between(x, low, high) -> Column:
    """Inclusive; null if any operand is, even where one bound decides."""
    x, low, high = column(x), value(low), value(high)
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), (x >= low) & (x <= high))


def like(x, pattern: str) -> Column:
    r"""% and _, with \ to take one literally. Neither matches a line break."""
    return column(x).rlike(_regex(pattern))


def ilike(x, pattern: str) -> Column:
    return column(x).rlike("(?iu)" + _regex(pattern))


def _regex(pattern: str) -> str:
    out, at = "^", 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            out += _literal(pattern[at])
        else:
            out += {"%": ".*", "_": "."}.get(c) or _literal(c)
        at += 1
    return out + r"\z"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in " _-" else f"\\x{{{ord(c):x}}}"


def in_list(x, members) -> Column:
    """Null for a value that no member equals if a member is null."""
    return column(x).isin(*members)


def truthy(x) -> Column:
    """A number as a condition: any but zero."""
    return column(x) != 0
