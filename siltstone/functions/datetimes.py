"""Date-time functions over TEXT timestamps, which they return as TEXT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted forms are a date, with minutes, with seconds and any fraction, and RFC 3339.
FORMS = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2}(\.\d+)?)?|T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2}))?$"
TEXT = "yyyy-MM-dd HH:mm:ss"
UNITS = ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")
#: How patterns of TO_CHAR are written in Java.
PATTERNS = {"YYYY": "yyyy", "HH24": "HH", "HH12": "hh", "HH": "HH", "MI": "mm", "SS": "ss", "MM": "MM", "DD": "dd", "US": "SSSSSS", "MS": "SSS"}


def parse(x: Column) -> Column:
    """TEXT, or a timestamp as it is, to a timestamp without zone; null where no form fits. RFC 3339 keeps its own clock."""
    s = x.cast("string")
    return F.when(s.rlike(FORMS), s.try_cast("timestamp_ntz"))


def text(t: Column) -> Column:
    return F.date_format(t, TEXT)


def date_trunc(unit: str, x: Column) -> Column:
    """To the year, month, day, hour, minute or second; an unknown unit means the day."""
    u = unit.upper() if unit.upper() in UNITS else "DAY"
    return text(F.date_trunc(u, parse(x)))


def extract(field: str, x: Column, unix: bool = False) -> Column:
    """YEAR to SECOND, DOW (0 is Sunday), DOY, QUARTER or WEEK (ISO) as INT; ``unix``: x is in seconds since 1970."""
    t = F.timestamp_seconds(x) if unix else parse(x)
    fields = {
        "YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
        "DOW": lambda c: F.dayofweek(c) - 1, "DOY": F.dayofyear, "QUARTER": F.quarter, "WEEK": F.weekofyear,
    }
    if field.upper() not in fields:
        raise ValueError(f"unknown EXTRACT field {field}")
    return fields[field.upper()](t).cast("bigint")


def java_pattern(pattern: str) -> str:
    """A pattern of YYYY, MM, DD, HH24, HH12, MI, SS, MS and US as Java has it; other text as it is."""
    java, at, up = "", 0, pattern.upper()
    while at < len(up):
        token = next((t for t in sorted(PATTERNS, key=len, reverse=True) if up.startswith(t, at)), None)
        c = pattern[at]
        java += PATTERNS[token] if token else "''" if c == "'" else f"'{c}'" if c.isalpha() else c
        at += len(token) if token else 1
    return java


def to_char(x: Column, pattern: str) -> Column:
    """Formats a timestamp by a pattern (see ``java_pattern``)."""
    return F.coalesce(F.date_format(parse(x), java_pattern(pattern)), x.cast("string"))


def to_timestamp(x: Column) -> Column:
    return text(parse(x))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def age(x: Column, at: Column | None = None) -> Column:
    """Approximate years, months and days up to now, or to ``at``, as text; leading zero parts are left out."""
    end = F.localtimestamp() if at is None else parse(at)
    hours = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(parse(x).cast("timestamp"))) / F.lit(3_600_000_000.0)
    # Hours of a mean year and of a mean month.
    years = (hours / 8766.0).cast("bigint")
    months = (hours / 730.56 - years * 12).cast("bigint")
    days = (hours / 24).cast("bigint") - years * 365 - months * 30
    full = F.format_string("%d years %d months %d days", years, months, days)
    return F.when(years > 0, full).when(months > 0, F.format_string("%d months %d days", months, days)).when(hours.isNotNull(), F.format_string("%d days", days))
