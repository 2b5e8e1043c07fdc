"""The engine's four column types and strict checks of values against them."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK = {"INT": T.LongType(), "INTEGER": T.LongType(), "SERIAL": T.LongType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
_PYTHON = {"bigint": int, "double": float, "string": str, "binary": (bytes, bytearray)}


class TypeMismatch(Exception):
    """A value whose type is not its column's."""


def spark_type(name: str) -> T.DataType:
    """The Spark type of INT, FLOAT, TEXT or BLOB (any case)."""
    try:
        return SPARK[name.upper()]
    except KeyError:
        raise TypeMismatch(f"unknown type {name}") from None


def name_of(t: T.DataType) -> str:
    """The engine's name for a Spark type."""
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "FLOAT"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)):
        return "INT"
    return "BLOB" if isinstance(t, T.BinaryType) else "TEXT"


def check(value: object, t: T.DataType, column: str) -> None:
    """Raises unless the value is null or of just this type (no silent casts)."""
    if value is not None and (not isinstance(value, _PYTHON[t.simpleString()]) or isinstance(value, bool)):
        raise TypeMismatch(f"column {column}: {type(value).__name__} is not {name_of(t)}")
