"""URL filters by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule set of up to this many bytes is sent to every executor; a larger one is joined by shuffling.
BROADCAST_RULES = 8 << 20


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Judges every url by ``rules`` (host, path, verdict): one row (page_id, host, path, rule, verdict) for each.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Each distinct
    (host, path) is expanded into the host suffixes and path prefixes of the lengths that rules have; the
    expressions meet the rules by the first 32 bits of their hash, then whole expressions are compared.
    The longest rule wins; of equal length, that with the longer host, then ``block``. Without a rule the
    verdict is ``default``. Null urls, and urls without ``://``, have empty host and path. Rules with a
    null host, path or verdict are ignored; without rules every page has the default. Repeated pages are
    judged each; other columns are left out, so their names can't clash.
    """
    host, path = split_url(F.col("url"))
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"))
    parsed = narrow.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).dropna()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rules = rules.withColumn("short", F.xxhash64(F.concat_ws("\n", "rule_host", "rule_path")).bitwiseAND(0xFFFFFFFF))
    # Distinct lengths only: as many as the longest rule has labels and characters.
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("lengths"), F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + F.octet_length("rule_verdict") + 64), F.lit(0)).alias("bytes")).first()
    if shape["bytes"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    labels = F.split("host", r"\.")
    suffix = F.explode(F.array(*[F.when(F.size(labels) >= k, F.substring_index("host", ".", -k)) for k in sorted(shape["labels"])] or [F.lit(None).cast("string")]))
    prefix = F.explode(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape["lengths"])] or [F.lit(None).cast("string")]))
    asked = parsed.select("host", "path").distinct()
    asked = asked.withColumn("suffix", suffix).where("suffix IS NOT NULL").withColumn("prefix", prefix).where("prefix IS NOT NULL")
    asked = asked.withColumn("short", F.xxhash64(F.concat_ws("\n", "suffix", "prefix")).bitwiseAND(0xFFFFFFFF))
    hits = asked.join(rules, "short").where((F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), F.col("rule_verdict"), name.alias("rule"))).alias("best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URL_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed) u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, parsed.host, parsed.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN judged ON parsed.host = judged.host AND parsed.path = judged.path
"""
