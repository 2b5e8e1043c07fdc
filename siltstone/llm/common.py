"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: What separates words: space and the ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, as in tests on one machine, a temporary folder takes its place; on a cluster, whose
    executors would not see it, that is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        there = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(there)
    return there


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of ours, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where columns of ``df`` have them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its partitions and their order."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tidy(spark: SparkSession) -> None:
    """Lets Spark remove the shuffles, broadcasts and plans of rounds that are over; it does so when the driver collects garbage."""
    spark._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces that hold about ``most`` bytes of ``column`` (one row at least).

    This bounds what a Python worker keeps in memory at once, however long the texts are.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size + 64)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts(column: pa.Array) -> list[str | None]:
    """A string column's values; what is no UTF-8 in them reads as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds ``out``: the total of ``value`` over all rows before each one in the order given.

    Range-sorts the rows, keeps them, takes one total for each partition (that many numbers reach the
    driver) and adds the totals of the earlier partitions to a running sum within each partition.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    sums = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(value).alias("s")).collect()
    base, at = {}, 0
    for p, s in sorted((r["p"], r["s"] or 0) for r in sums):
        base[p] = at
        at += s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        so_far = base.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = so_far + np.cumsum(v)
            so_far = int(ends[-1]) if len(v) else so_far
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - v)], names=[*b.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    return ranged.mapInArrow(run, f"{kinds}, `{out}` long")
