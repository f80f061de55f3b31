"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, maxent, media, nearjoin, packing, quality, suffix, toxicity, urls, warc
from .shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(table(spark, sf_dir, "documents"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = spark.sql("SELECT page_id, good FROM " + urls.OUTCOMES_SQL, pages=pages.select("page_id", "url"), labels=table(spark, sf_dir, "labels"))
    return urls.judge(pages, outcomes)


def op7_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_nearjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.near_classes(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_decontam, op3_packing, op4_suffix, op5_media, op6_urls, op7_maxent, op8_quality, op9_nearjoin, op10_warc)}

OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT html, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY html)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(encode(p.html)) AS payload_digest,
  CASE WHEN g.kept <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.kept <> p.page_id THEN g.kept END AS refers_to
FROM p LEFT JOIN g ON p.n >= 1000 AND p.html = g.html"""

ORACLES = {
    "op6_urls": urls.reputation_sql("pages", urls.OUTCOMES_SQL.format(pages="pages", labels="labels")).replace("AS STRING", "AS VARCHAR"),
    "op10_warc": OP10_SQL,
}
