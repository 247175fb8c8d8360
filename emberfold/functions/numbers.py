"""Arithmetic and numeric functions. Under ANSI settings overflow raises by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, fail, value

WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def int_div(a, b) -> Column:
    """Whole numbers divide toward zero; a divisor of 0 is an error."""
    return F.call_function("div", value(a), value(b))


def remainder(a, b) -> Column:
    """The sign is the dividend's."""
    return value(a) % value(b)


def power(a, b) -> Column:
    """Double."""
    return F.pow(value(a).cast("double"), value(b).cast("double"))


def exponentiate(a, n: int, kind: str = "bigint") -> Column:
    """a ** n for whole numbers: exact for small powers, double beyond; x ** 0 is 1; 0 to a negative power is an error."""
    a = value(a)
    if n == 0:
        return F.when(a.isNotNull(), F.lit(1)).cast(kind)
    if 0 < n < 20:
        return reduce(lambda x, y: x * y, [a.cast(kind)] * n)
    return F.when(a == 0, fail("0 to a negative power", "double") if n < 0 else F.lit(0.0)).otherwise(power(a, n))


def factorial(x, wide: bool = False) -> Column:
    """0 to 20 as BIGINT, or to 33 as DECIMAL(38,0); outside it is an error."""
    x, most = column(x).cast("int"), 33 if wide else 20
    table, product = [], 1
    for n in range(most + 1):
        product *= max(n, 1)
        table.append(F.lit(str(product)).cast("decimal(38,0)" if wide else "bigint"))
    kind = "decimal(38,0)" if wide else "bigint"
    return F.when(x < 0, fail("factorial of a negative number", kind)).when(x > most, fail(f"factorial above {most}", kind)).otherwise(F.get(F.array(*table), x))


def _shift(name: str, a, n, kind: str) -> Column:
    a, n = value(a).cast(kind), value(n).cast("int")
    function = F.call_function(name, a, n).cast(kind)
    return F.when((n < 0) | (n >= WIDTHS[kind]), fail("shift outside the width", kind)).otherwise(function)


def shift_left(a, n, kind: str = "bigint") -> Column:
    return _shift("shiftleft", a, n, kind)


def shift_right(a, n, kind: str = "bigint") -> Column:
    return _shift("shiftright", a, n, kind)


def bit_and(a, b) -> Column:
    return value(a).bitwiseAND(value(b))


def bit_or(a, b) -> Column:
    return value(a).bitwiseOR(value(b))


def bit_xor(a, b) -> Column:
    return value(a).bitwiseXOR(value(b))


def bit_not(a) -> Column:
    return F.bitwise_not(value(a))


def sqrt(x) -> Column:
    x = value(x).cast("double")
    return F.when(x < 0, fail("square root of a negative number", "double")).otherwise(F.sqrt(x))


def round_(x, digits: int = 0, decimal: bool = False) -> Column:
    """Halves go away from zero; of decimals, to the even neighbour."""
    return F.bround(value(x), digits) if decimal else F.round(value(x), digits)


def ceil(x) -> Column:
    return F.ceil(value(x))


def floor(x) -> Column:
    return F.floor(value(x))


def unsigned(x, bits: int) -> Column:
    """Cast with the range check of an unsigned type, in the next wider signed one."""
    kind = {8: "smallint", 16: "int", 32: "bigint", 64: "decimal(20,0)", 128: "decimal(38,0)"}[bits]
    x = value(x)
    most = F.lit(str(min(2**bits, 10**38) - 1)).cast("decimal(38,0)")
    return F.when((x < 0) | (x.cast("decimal(38,0)") > most), fail(f"outside {bits} unsigned bits", kind)).otherwise(x.cast(kind))
