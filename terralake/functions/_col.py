"""Small helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: ColumnOrName | int | float) -> Column:
    """A column, a column name, or a plain number."""
    if isinstance(x, (int, float)):
        return F.lit(x)
    return col(x)


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, num(lo)), num(hi))


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


def half_up(x: Column) -> Column:
    """Round half towards +inf, the rule used for pixel positions."""
    return F.floor(x + F.lit(0.5)).cast("long")


def trunc_long(x: Column) -> Column:
    """Truncate towards zero."""
    return x.cast("long")


def alternatives(words) -> str:
    return "(" + "|".join(words) + ")"
