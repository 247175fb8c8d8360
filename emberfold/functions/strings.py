"""String functions. Positions count characters from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, fail, value

#: The characters that a trim without a set takes: Unicode white space.
WHITE = r"[\p{IsWhite_Space}]"


def upper(s) -> Column:
    return F.upper(column(s))


def lower(s) -> Column:
    return F.lower(column(s))


def length(s, of: str = "text") -> Column:
    """Characters of text, bytes of binary, or the number of elements of a collection; null gives null."""
    s = column(s)
    if of == "text":
        return F.length(s).cast("long")
    if of == "bytes":
        return F.octet_length(s).cast("long")
    return F.when(s.isNotNull(), F.size(s)).cast("long")


def concat(first, *rest) -> Column:
    """Nulls are skipped, but a null first argument gives null."""
    first = value(first)
    return F.when(first.isNotNull(), F.concat_ws("", first.cast("string"), *(value(x).cast("string") for x in rest)))


def concat_lists(first, *rest) -> Column:
    first = column(first)
    empty = F.slice(first, 1, 0)
    return F.when(first.isNotNull(), F.concat(first, *(F.coalesce(column(x), empty) for x in rest)))


def concat_op(*parts) -> Column:
    """a || b: anything as text; a null gives null."""
    return F.concat(*(value(x).cast("string") for x in parts))


def substr(s, start, size=None) -> Column:
    """A start of 0 is 1; a negative one counts from the end, no further than the first character; a size under 0 is an error."""
    s, start = column(s), value(start).cast("int")
    n = F.length(s)
    first = F.when(start > 0, start).when(start < 0, F.greatest(n + start, F.lit(0)) + 1).otherwise(F.lit(1))
    if size is None:
        return F.substring(s, first, n)
    size = value(size).cast("int")
    return F.when(size < 0, fail("SUBSTR takes a length of 0 or more")).otherwise(F.substring(s, first, size))


def trim(s, chars=None, side: str = "both") -> Column:
    """Without characters, Unicode white space; with them, any of the set."""
    s = column(s)
    if chars is None:
        if side in ("both", "leading"):
            s = F.regexp_replace(s, f"^{WHITE}+", "")
        return F.regexp_replace(s, f"{WHITE}+$", "") if side in ("both", "trailing") else s
    return {"both": F.trim, "leading": F.ltrim, "trailing": F.rtrim}[side](s, value(chars))


def ltrim(s, chars=None) -> Column:
    return trim(s, chars, "leading")


def rtrim(s, chars=None) -> Column:
    return trim(s, chars, "trailing")


def replace(s, old, new) -> Column:
    return F.replace(column(s), value(old), value(new))


def reverse(s) -> Column:
    """Text by characters, or a list."""
    return F.reverse(column(s))


def contains(s, part) -> Column:
    return F.contains(column(s), value(part))


def find_idx(s, part, start=None) -> Column:
    """The first place from 1; 0 if the part is absent or empty. A start under 1 is an error."""
    s, part = column(s), value(part)
    if start is None:
        return F.when(part == "", F.lit(0)).otherwise(F.instr(s, part)).cast("long")
    start = value(start).cast("int")
    found = F.call_function("locate", part, s, start)
    return F.when(start < 1, fail("FIND_IDX starts at 1", "int")).when(part == "", F.lit(0)).otherwise(found).cast("long")


def is_empty(s, of: str = "text") -> Column:
    return length(s, of) == 0
