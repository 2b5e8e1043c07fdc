"""Named queries over the test tables, each with its DuckDB twin where SQL can express it."""

from . import aggregates, changes, extras, joins, scalars, scans, sets, text  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
