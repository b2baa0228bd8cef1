"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    lexical, licenses, line_dedup, mixing, ngram_join, packing, paragraph_dedup, quality_rules, suffix_dedup, topk, urls, warc, whitening,
)
from .common import table

# The rules of op13 as (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages of all documents with their components."""
    return paragraph_dedup.repeated_parts(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and host verdict of every document."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and the numbers of those that go."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every twentieth one."""
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, F.col("vec_id") % 20 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 400-byte strings that occur twice."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence template of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back."""
    archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(whitening.integer_vectors(table(spark, sf_dir, "embeddings")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; the rules' own verdicts are the labels of the model."""
    judged = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_paragraph_dedup, op2_quality_rules, op3_line_dedup, op4_harmonic_packing, op5_topk_search, op6_suffix_dedup, op7_ngram_join, op8_source_mix,
        op9_license_scan, op10_warc, op11_lexical_search, op12_embedding_whitening, op13_url_filter,
    )
}
