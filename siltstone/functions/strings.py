"""String functions. Null arguments give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import to_text

#: Fixed value: what LTRIM and RTRIM take off.
BLANKS = " \t\n\r"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def substring(s: Column, start, length=None) -> Column:
    """1-based, in bytes like LENGTH and STRPOS; a start below 1 counts as 1 and does not shorten the length."""
    raw, start = s.cast("string").cast("binary"), F.greatest(_lit(start), F.lit(1)).cast("int")
    part = F.substr(raw, start) if length is None else F.substr(raw, start, F.greatest(_lit(length), F.lit(0)).cast("int"))
    return part.cast("string")


def concat(*parts: Column) -> Column:
    """Null if any part is null; numbers as text."""
    return F.concat(*[to_text(p) for p in parts])


def concat_ws(sep, *parts: Column) -> Column:
    """Skips null and empty parts; null for a null separator."""
    return F.call_function("concat_ws", _lit(sep), *[F.nullif(to_text(p), F.lit("")) for p in parts])


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def length(s: Column) -> Column:
    """Bytes of a text or blob."""
    return F.octet_length(s).cast("long")


def trim(s: Column) -> Column:
    """Without white space (Unicode's) at both ends."""
    return F.regexp_replace(s, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def ltrim(s: Column) -> Column:
    return F.ltrim(s, F.lit(BLANKS))


def rtrim(s: Column) -> Column:
    return F.rtrim(s, F.lit(BLANKS))


def replace(s: Column, old, new) -> Column:
    return F.replace(s, _lit(old), _lit(new))


def strpos(s: Column, part) -> Column:
    """1-based place in bytes of the first occurrence, 0 without one."""
    at = F.locate(part, s) if isinstance(part, str) else F.call_function("locate", part, s)
    return F.when(at > 0, F.octet_length(F.substr(s, F.lit(1), at - 1)) + 1).otherwise(at).cast("long")


def split_part(s: Column, sep, n) -> Column:
    """The n-th field, from 1; empty for others."""
    n = _lit(n)
    return F.when(n > 0, F.split_part(s, _lit(sep), F.greatest(n, F.lit(1)))).when(s.isNotNull() & n.isNotNull(), F.lit(""))
