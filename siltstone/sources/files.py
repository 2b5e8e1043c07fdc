"""Sources and sinks: scans with pushdown, sorted bulk loads, snapshots, and ordered key-value ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file that a bulk load writes, about.
FILE_ROWS = 2_000_000


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A table's rows; columns and conditions reach the Parquet reader."""
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    df = df.select(*columns) if columns else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def prefix_scan(spark: SparkSession, path: str, column: str, prefix: str) -> DataFrame:
    """``column LIKE 'prefix%'``, which row groups' statistics can skip."""
    return spark.read.parquet(path).where(F.col(column).startswith(prefix))


def bulk_load(df: DataFrame, path: str, *keys: str, files: int | None = None) -> None:
    """Writes files that are sorted by key, within and across, so that later ranges skip row groups."""
    df.repartitionByRange(files or max(1, -(-df.count() // FILE_ROWS)), *keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """Adds rows by name; columns must be those of what is there."""
    there = df.sparkSession.read.parquet(path)
    df.select(*[F.col(f.name).cast(f.dataType) for f in there.schema.fields]).write.mode("append").parquet(path)


def snapshot(spark: SparkSession, path: str, to: str) -> None:
    """A copy of a table as it is now."""
    spark.read.parquet(path).write.mode("errorifexists").parquet(to)


def key_range(spark: SparkSession, path: str, low: object = None, high: object = None, limit: int | None = None, key: str = "key") -> DataFrame:
    """Rows with low <= key < high in key order."""
    df = spark.read.parquet(path)
    df = df if low is None else df.where(F.col(key) >= F.lit(low))
    df = df if high is None else df.where(F.col(key) < F.lit(high))
    df = df.orderBy(key)
    return df if limit is None else df.limit(limit)


def without_range(spark: SparkSession, path: str, low: object, high: object, key: str = "key") -> DataFrame:
    """What a delete of low <= key < high leaves."""
    return spark.read.parquet(path).where(~F.coalesce((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high)), F.lit(False)))
