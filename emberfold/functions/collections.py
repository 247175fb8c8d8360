"""Lists, maps, structs and JSON. Places in lists count from 0."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, fail, value


def element(xs, i) -> Column:
    """a[i]: outside the list, and for a negative place, null."""
    return F.get(column(xs), value(i))


def map_element(m, key) -> Column:
    return F.try_element_at(column(m), value(key))


def append(xs, x) -> Column:
    xs = column(xs)
    return F.when(xs.isNotNull(), F.array_append(xs, value(x)))


def prepend(x, xs) -> Column:
    xs = column(xs)
    return F.when(xs.isNotNull(), F.array_prepend(xs, value(x)))


def sort(xs, order: str = "ASC") -> Column:
    """Null last ascending, first descending."""
    ascending = F.array_sort(column(xs))
    return ascending if order.upper() == "ASC" else F.reverse(ascending)


def dedup(xs) -> Column:
    """The first of equal elements stays; nulls are equal."""
    return F.array_distinct(column(xs))


distinct = dedup


def slice_(xs, start, end=None) -> Column:
    """The end is left out; negative places count from the end; both are drawn into the list."""
    xs = column(xs)
    n = F.size(xs)

    def place(i) -> Column:
        i = value(i).cast("int")
        return F.when(i < 0, F.greatest(n + i, F.lit(0))).otherwise(F.least(i, n))

    first, last = place(start), n if end is None else place(end)
    return F.when(xs.isNotNull(), F.slice(xs, first + 1, F.greatest(last - first, F.lit(0))))


def splice(xs, start, delete, insert=None) -> Column:
    """Take out `delete` elements from a place and put others there; a negative place is an error."""
    xs, start = column(xs), value(start).cast("int")
    n = F.size(xs)
    first = F.least(start, n)
    gone = F.least(F.greatest(value(delete).cast("int"), F.lit(0)), n - first)
    head, tail = F.slice(xs, F.lit(1), first), F.slice(xs, first + gone + 1, n - first - gone)
    empty = F.slice(xs, 1, 0)
    middle = empty if insert is None else F.coalesce(value(insert), empty)
    checked = F.when(start < 0, fail("SPLICE takes no negative place", "int")).otherwise(F.lit(1))
    return F.when(xs.isNotNull() & (checked == 1), F.concat(head, middle, tail))


def take(xs, n) -> Column:
    n = value(n).cast("int")
    return F.when(n < 0, F.slice(column(xs), 1, fail("TAKE takes 0 or more", "int"))).otherwise(F.slice(column(xs), F.lit(1), n))


def skip(xs, n) -> Column:
    xs, n = column(xs), value(n).cast("int")
    rest = F.slice(xs, F.least(n, F.size(xs)) + 1, F.greatest(F.size(xs) - n, F.lit(0)))
    return F.when(n < 0, F.slice(xs, 1, fail("SKIP takes 0 or more", "int"))).otherwise(rest)


def find_idx(xs, x) -> Column:
    """The first place, from 0; null if absent."""
    return F.nullif(F.array_position(column(xs), value(x)), F.lit(0).cast("long")) - 1


def flatten(xs) -> Column:
    """One level."""
    return F.flatten(column(xs))


def contains(xs, x) -> Column:
    return F.array_contains(column(xs), value(x))


def contains_key(m, key) -> Column:
    return F.map_contains_key(column(m), value(key))


def keys(m) -> Column:
    return F.map_keys(column(m))


def values(m) -> Column:
    return F.map_values(column(m))


def entries(m) -> Column:
    return F.map_entries(column(m))


def from_entries(xs) -> Column:
    """The last of duplicate keys wins, under the session's settings."""
    return F.map_from_entries(column(xs))


def merge(*maps) -> Column:
    """Later entries win; null maps are skipped."""
    maps = [column(m) for m in maps]
    present = F.coalesce(*maps)
    empty = F.map_filter(present, lambda k, v: F.lit(False))
    return F.map_concat(*(F.coalesce(m, empty) for m in maps))


def fields(schema) -> Column:
    """The names of a struct type's fields."""
    return F.array(*(F.lit(f.name) for f in schema.fields))


def unwrap(x, path: str, kinds: str) -> Column:
    """A dotted path: kinds names what each step goes into, s for struct, m for map, l for list. A miss is null."""
    out = column(x)
    for step, kind in zip(path.split("."), kinds, strict=True):
        if kind == "l":
            out = F.get(out, F.lit(int(step)))
        else:
            out = out.getField(step) if kind == "s" else F.try_element_at(out, F.lit(step))
    return out


def unwrap_json(text, path: str, kind: str) -> Column:
    """A dotted path into JSON text, as a type; a miss is null."""
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split("."))
    return F.try_variant_get(F.parse_json(column(text)), "$" + steps, kind)


def json(text) -> Column:
    return F.parse_json(column(text))


def literal_list(*xs) -> Column:
    return F.array(*map(value, xs))


def literal_map(pairs: dict) -> Column:
    """Keys that are not strings are left out."""
    kept = [value(x) for k, v in pairs.items() if isinstance(k, str) for x in (k, v)]
    return F.create_map(*kept)


