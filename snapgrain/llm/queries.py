"""Thin queries over the operators of this subpackage, one for each, on whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import byte_bpe, pack_documents

    encoder = byte_bpe(_tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pack_documents(_table(spark, sf_dir, "documents"), encoder, capacity=2048, closing=0)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import link_components

    return link_components(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_main import extract

    return extract(_table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import encode

    return encode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), digests=True)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import graded

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded(docs, _table(spark, sf_dir, "labels")).select("doc_id", "expected", "tail", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import kept_digests

    return kept_digests(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import neighbours_and_edits

    return neighbours_and_edits(_table(spark, sf_dir, "documents").select("doc_id", "text"), classes=True)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_jaccard_join, op3_html_extraction, op4_bpe, op5_license_scan, op6_quality_classifier, op7_warc, op8_substring_dedup, op9_exact_dedup, op10_fingerprints)}

ORACLE = {
    "op9_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
    "op7_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
             g AS (SELECT body, min(page_id) AS first_id FROM t GROUP BY body)
        SELECT t.page_id, t.n::BIGINT AS payload_bytes, sha256(t.body) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM t JOIN g ON t.body = g.body
    """,
}
