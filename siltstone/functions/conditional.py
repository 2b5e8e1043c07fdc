"""COALESCE, NULLIF and searched CASE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coalesce(*xs: Column) -> Column:
    return F.coalesce(*xs)


def nullif(a: Column, b: Column) -> Column:
    """Null where both are equal; a where b is null."""
    return F.nullif(a, b)


def case(*branches: tuple[Column, Column], otherwise: Column | None = None) -> Column:
    """The value of the first branch whose condition is true."""
    out = F.when(*branches[0])
    for cond, value in branches[1:]:
        out = out.when(cond, value)
    return out if otherwise is None else out.otherwise(otherwise)
