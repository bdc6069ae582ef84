"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.llm import bpe, decontaminate, language, quality, quality_rules, sharding, simhash, token_counts, toxicity, url_lists
from ionlake.llm.common import table

#: Shards of the production layout.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def quality_ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 poor, 1 good prose that is toxic, 2 good."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0)))
    return labels.select("doc_id", grade.cast("int").alias("grade"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents"), quality_ratings(table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), "doc_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, ["doc_id"], sharding.fill_table(SHARDS)).select("doc_id", "slot", "shard")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), "doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


#: Captures come without a time, so each gets one within 2024 from its id.
YEAR_START, YEAR_SECONDS = 1704067200, 31536000
#: Rules for whole domains, as (entry_id, domain, action, effective).
DOMAIN_RULES = [
    (1, "example.org", "review", 1704067200),
    (2, "example.org", "remove", 1719792000),
    (3, "example.com", "review", 1711929600),
    (4, "spam-farm.example.org", "block", 1706745600),
    (5, "cheap-pills.example.com", "block", 1704067200),
    (6, "cheap-pills.example.com", "allow", 1717200000),
    (7, "cheap-pills.example.com", "block", 1725148800),
]


def url_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (F.lit(YEAR_START) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR_SECONDS))).alias("fetched"))


def url_entries(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A dated list: the domain rules, and for hosts seen in the pages entries dated by a digest of the host.

    A quarter of the hosts are blocked at some time; half of these are taken off again within a quarter of a year.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("domain")).where("domain <> ''").distinct()
    v = F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("long")
    hosts = hosts.withColumn("v", v).where("v % 4 = 0")
    since = F.lit(YEAR_START) + F.col("v") % YEAR_SECONDS
    put = hosts.select((F.col("v") * 2 + 100).alias("entry_id"), "domain", F.lit("block").alias("action"), since.alias("effective"))
    off = hosts.where("v % 8 = 0").select((F.col("v") * 2 + 101).alias("entry_id"), "domain", F.lit("remove").alias("action"), (since + F.lit(86400) * (1 + F.col("v") % 90)).alias("effective"))
    rules = spark.createDataFrame(DOMAIN_RULES, "entry_id long, domain string, action string, effective long")
    return rules.unionByName(put).unionByName(off)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.filter_urls(url_captures(pages), url_entries(spark, pages))


OP10_SQL = f"""
WITH cap AS (
  SELECT page_id, url, {YEAR_START} + (page_id * 7919) % {YEAR_SECONDS} AS fetched,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') AS host
  FROM pages),
hosts AS (SELECT DISTINCT host AS domain, ('0x' || substr(md5(host), 1, 8))::BIGINT AS v FROM cap WHERE host <> ''),
entries AS (
  SELECT * FROM (VALUES {", ".join(f"({i}, '{d}', '{a}', {t})" for i, d, a, t in DOMAIN_RULES)}) AS r(entry_id, domain, action, since)
  UNION ALL SELECT v * 2 + 100, domain, 'block', {YEAR_START} + v % {YEAR_SECONDS} FROM hosts WHERE v % 4 = 0
  UNION ALL SELECT v * 2 + 101, domain, 'remove', {YEAR_START} + v % {YEAR_SECONDS} + 86400 * (1 + v % 90) FROM hosts WHERE v % 8 = 0),
one AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY domain, since ORDER BY entry_id DESC) = 1),
spans AS (SELECT *, lead(since) OVER (PARTITION BY domain ORDER BY since) AS until FROM one),
hits AS (
  SELECT c.page_id, c.url, c.fetched, s.domain, s.action, s.entry_id,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(s.domain) DESC) AS k
  FROM cap c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain))
    AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until) AND s.action <> 'remove')
SELECT c.page_id, c.url, c.fetched, c.host, h.entry_id, h.domain AS matched, coalesce(h.action, 'none') AS decision
FROM cap c LEFT JOIN hits h ON h.page_id = c.page_id AND h.k = 1
"""

QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_url_filters": op10_url_filters,
}
ORACLES = {"op10_url_filters": OP10_SQL}
