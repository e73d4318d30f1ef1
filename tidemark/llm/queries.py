"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import licenses, mixing
from tidemark.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.warc import warc_round_trip

    back = warc_round_trip(table(spark, sf_dir, "pages"))
    return back.where("status = 'ok'").select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.packing import pack

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.graph import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lines import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import simhash_components

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.radix import radix_dedup

    return radix_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), "copies"
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.negatives import hard_negatives, quantised

    vectors = quantised(table(spark, sf_dir, "embeddings"), relabel=7)
    return hard_negatives(vectors, lambda vec_id: vec_id % 100 == 0)


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import suffix_tree_scores

    return suffix_tree_scores(table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.spelling import variants, words

    return variants(words(table(spark, sf_dir, "documents"), slip=97))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_best_fit_packing, op3_quality, op4_toxicity, op5_near_vectors, op6_line_dedup, op7_simhash,
        op8_license_scan, op9_exact_dedup, op10_mixing, op11_hard_negatives, op12_suffix_tree, op13_spelling,
    )
}

ORACLE_SQL = {
    "op8_license_scan": licenses.oracle_sql(),
    "op10_mixing": mixing.oracle_sql(),
    "op1_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other_id,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER w AS rank, n.other_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)
QUALIFY rank <= 5""",
}
