"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, quality, simhash, substring, tokencount, topk, urlfilter, warc
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op1_mix_sources", mixing.MIX_SQL.format(docs="documents"))
def op1(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op2_top_k", topk.TOP_SQL)
def op2(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"))


@query("op3_simhash")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op4_quality")
def op4(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = quality.train(docs, table(spark, d, "labels"), fold(F.col("doc_id"), 4) != 2)
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query("op5_warc", warc.WARC_SQL)
def op5(spark: SparkSession, d: str) -> DataFrame:
    return warc.archive_pages(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_substring_dedup")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return substring.drop_repeats(table(spark, d, "documents")).select("doc_id", "text", "removed", "original_chars")


@query("op7_url_filter", urlfilter.URL_SQL)
def op7(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")
    return urlfilter.filter_urls(table(spark, d, "pages"), rules)


@query("op8_decontaminate")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return decontam.find_items(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_language_id")
def op9(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 3) != 1)
    return langid.identify(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query("op10_token_counts")
def op10(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
