"""The queries of this folder over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import bpe, filter_audit, html, language, lines, nn_descent, order_minhash, packing, secrets, simhash, spelling, url_filters, winnowing
from ledgerspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op2_line_dedup", lines.SQL)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents dropped everywhere."""
    return lines.digest(lines.line_dedup(table(spark, sf_dir, "documents")))


@query("op3_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of each document, its edited text and the next document."""
    return order_minhash.edited_likeness(table(spark, sf_dir, "documents"))


@query("op4_url_filters", url_filters.SQL)
def url_filter_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries in force when it was fetched."""
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(url_filters.dated_captures(pages), url_filters.dated_list(pages)).select(
        "page_id", "url", "host", "fetched_on", "pattern", "action", "kept"
    )


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest linked doc_id of each document, by 4-word SimHash at 4 bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document and their decoded text, as digests."""
    return bpe.digest(bpe.round_trip(table(spark, sf_dir, "documents")))


@query("op7_html_extraction")
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html.extract(table(spark, sf_dir, "pages"))


@query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that are not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_secret_scan")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in each document."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op10_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.9."""
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op11_filter_interaction_audit", filter_audit.SQL)
def filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each place of all their orders, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_benchmark_decontamination", winnowing.SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in ten-word windows of benchmark items."""
    return winnowing.digest(winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op13_spelling_variants")
def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent word that each may be a misspelling of."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))
