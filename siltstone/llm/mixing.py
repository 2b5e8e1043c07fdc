"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prefix_sum, word_count

#: Copies of a source's row to join with, so that a hot source is spread over as many tasks.
SALTS = 32


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds to one row a source (source, source_size) its weight, start and target.

    The total of all sizes is shared by weight; a target stops at ``most`` times its source's size and
    the excess is shared again by weight among the others until none is above. Only two sums a round
    reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sum(sizes.withColumn("one", F.lit(1).cast("long")), order, "one", "rank")
    ranked = prefix_sum(ranked, order, "source_size", "start")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = cut(ranked.select("source", "source_size", "start", weight.cast("long").alias("weight")))
    top = F.col("source_size") * most
    total, heavy = (x or 0 for x in src.agg(F.sum("source_size"), F.sum("weight")).first())
    held, level = 0, 0.0
    while heavy:
        level = (total - held) / heavy
        full = top.cast("double") <= F.lit(level) * F.col("weight")
        now = tuple(x or 0 for x in src.agg(F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("weight")))).first())
        if now == (held, heavy):
            break
        held, heavy = now
    return src.withColumn("target", F.least(top.cast("double"), F.lit(level) * F.col("weight")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How many words of each document a mix takes, so that every source meets its target exactly.

    Every row gets a key that is a hash of its id (of its text, where the id is null); rows are range-sorted by source and key; distributed
    prefix sums of word counts place each row on its source's line. A source's budget is its target,
    rounded down. Whole epochs take every document; the last epoch takes documents in key order and cuts
    the one at the budget's end to the words that are left. ``copies`` are the whole epochs, ``part`` the
    words of the last, and ``taken`` the words of both.

    Null texts, and texts without words, have size 0 and give nothing. A null source is a source of its
    own and comes last. Rows with equal source and id are in the order of their sizes; rows equal in all
    three can't be told apart. An empty table gives an empty result. Other columns are left out, so their
    names can't clash.
    """
    name = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))
    key = F.substring(F.md5(F.concat(F.lit(seed), name).cast("binary")), 1, 16)
    # The last number parts rows that are equal otherwise, so that they are spread over tasks as well.
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("nth")))
    src = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    placed = prefix_sum(sized, [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("nth")], "size", "before")
    salted = src.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "s")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    joined = placed.join(salted, placed["source"].eqNullSafe(salted["s"]) & (placed["salt"] == salted["salt"]))
    budget = F.floor("target")
    copies = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = budget - copies * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("before") - F.col("start")))).cast("long")
    out = joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), part.alias("part"))
    return out.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


#: Text of the mix in DuckDB's SQL, over a view ``{docs}``.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix' || doc_id::VARCHAR), 1, 16) AS key
  FROM {docs}),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
ratios AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT a.k, (sum(b.source_size)::BIGINT - coalesce(sum(3 * b.source_size) FILTER (b.k < a.k), 0)::BIGINT)
              / (sum(b.weight) FILTER (b.k >= a.k))::DOUBLE AS level,
         any_value(3 * a.source_size) AS top, any_value(a.weight) AS weight
  FROM ratios a CROSS JOIN ratios b GROUP BY a.k),
chosen AS (SELECT level FROM levels WHERE top::DOUBLE > level * weight ORDER BY k LIMIT 1),
aims AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM chosen), 0.0) * weight) AS target FROM sources),
lines AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING))::BIGINT - s.size AS before
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
         + greatest(0, least(size, budget - (budget // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM lines
"""
