"""Queries of the corpus operators over the standard tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.llm import byte_bpe, fingerprints, ngram_join, packing, pii, quality_classifier, quality_rules, secret_scan, sharding, warc
from lontar.llm.common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="public demonstration key")


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


ORACLE["op3_sharding"] = """
WITH RECURSIVE crc_table AS (
  SELECT i AS n, CASE WHEN i % 2 = 1 THEN xor(i // 2, 3988292384) ELSE i // 2 END AS v, 1 AS step FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL
  SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM crc_table WHERE step < 8
),
crc_list AS (SELECT list(v ORDER BY n) AS t FROM crc_table WHERE step = 8),
light AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')]),
      lambda a, b : xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS text_crc32,
    ('0x' || substr(md5('interleave:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents, crc_list
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY k, doc_id, size, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM light
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (256 * r + ('0x' || substr(md5('interleave:source:' || coalesce(source, 'null')), 1, 2))::BIGINT)::DOUBLE / (256 * n)::DOUBLE, source NULLS FIRST, k, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 24 // total)::INTEGER AS shard,
  (p - ((p * 24 // total) * total + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode_column(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], keep_ids=False)


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edits(table(spark, sf_dir, "documents"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


ORACLE["op8_warc"] = """
SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to, true AS intact
FROM (SELECT *, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM pages)
"""


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.train(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model, keep=["doc_id"])
