"""Casts. Text that is no number is an error, as in ANSI mode; FLOAT to INT cuts off the fraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(x: Column) -> Column:
    return x.cast("bigint")


def to_float(x: Column) -> Column:
    return x.cast("double")


def to_text(x: Column) -> Column:
    """Numbers in their shortest form: 1.0 as 1."""
    return F.regexp_replace(x.cast("string"), r"^(-?\d+)\.0$", "$1") if not isinstance(x, str) else F.lit(x)


def float_to_text(x: Column) -> Column:
    """A FLOAT without exponent and without a trailing .0."""
    plain = F.rtrim(F.format_string("%.17f", x), F.lit("0"))
    short = x.cast("string")
    return F.when(short.contains("E"), F.regexp_replace(plain, r"\.$", "")).otherwise(F.regexp_replace(short, r"\.0$", ""))


def to_blob(x: Column) -> Column:
    return x.cast("string").cast("binary")
