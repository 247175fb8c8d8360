"""Points, struct<x double, y double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import column, value


def point(x, y) -> Column:
    return F.struct(value(x).cast("double").alias("x"), value(y).cast("double").alias("y"))


def get_x(p) -> Column:
    return column(p)["x"]


def get_y(p) -> Column:
    return column(p)["y"]


def calc_distance(p, q) -> Column:
    """Euclidean; null if either point is."""
    p, q = column(p), column(q)
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)
