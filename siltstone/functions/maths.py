"""Math functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def abs_(x: Column) -> Column:
    return F.abs(x)


def ceil(x: Column) -> Column:
    """A FLOAT stays one."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    """A FLOAT stays one."""
    return F.floor(x).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from zero; negative digits round before the point."""
    return F.round(x, digits)


def mod(a: Column, b: Column) -> Column:
    """The sign is the dividend's; division by zero is an error."""
    return a % b


def safe_mod(a: Column, b: Column) -> Column:
    return F.try_mod(a, b)


def int_div(a: Column, b: Column) -> Column:
    """Whole division, cut off towards zero."""
    return F.call_function("div", a, b)


def greatest(*xs: Column) -> Column:
    """Nulls are skipped."""
    return F.greatest(*xs)


def least(*xs: Column) -> Column:
    return F.least(*xs)


def random() -> Column:
    """From 0 up to, not including, 1."""
    return F.rand()
