"""Corpus aggregates, coverage and integrity checks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.filings import ANNUAL_REPORT_KEYWORD, CONCALL_KEYWORD
from foliospark.session import broadcast_if_small, stored

MAX_KEYS = 200_000
DISPLAY_ZONE = "Asia/Kolkata"


def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per document; documents without chunks do not appear. The chunk table is
    reduced to one row per document before it meets the documents."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, documents["id"] == counts["document_id"]).select(
        "id", "symbol", "doc_type", "period", "chunk_count"
    )


def token_stats(chunks: DataFrame) -> DataFrame:
    """Average tokens per chunk over everything, one decimal."""
    return chunks.agg(F.round(F.avg("token_count"), 1).alias("avg_tokens"))


def token_stats_by_document(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    stats = chunks.groupBy("document_id").agg(
        F.round(F.avg("token_count"), 1).alias("avg_tokens"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
    )
    return documents.join(stats, documents["id"] == stats["document_id"]).select(
        "id", "symbol", "doc_type", "avg_tokens", "min_tokens", "max_tokens"
    )


def coverage(companies: DataFrame, documents: DataFrame) -> DataFrame:
    """Each company with its downloaded annual reports and concalls, zero by default."""
    counts = (
        documents.filter("storage_path IS NOT NULL")
        .groupBy("symbol")
        .agg(
            F.count_if(F.col("doc_type") == "annual_report").alias("annual_reports"),
            F.count_if(F.col("doc_type") == "concall").alias("concalls"),
        )
    )
    return companies.join(counts, "symbol", "left").select(
        "symbol", "name", "industry",
        F.coalesce("annual_reports", F.lit(0)).alias("annual_reports"),
        F.coalesce("concalls", F.lit(0)).alias("concalls"),
    )


def freshness(documents: DataFrame) -> DataFrame:
    """Downloaded documents of every type and the day of the newest, in display time."""
    local = F.from_utc_timestamp(F.max("ingested_at"), DISPLAY_ZONE)
    return documents.filter("storage_path IS NOT NULL").agg(
        F.count("*").alias("total_documents"),
        F.date_format(local, "d MMM yyyy").alias("last_updated"),
    )


def table_counts(spark: SparkSession, tables: dict[str, DataFrame | Callable[[], DataFrame]],
                 ) -> DataFrame:
    """Rows per table. A table, or a function that opens one, that fails when it is opened or
    read is reported as unreadable, never as empty, and does not keep the others from being
    counted."""
    rows = []
    for name, table in tables.items():
        try:
            rows.append((name, (table() if callable(table) else table).count(), "ok"))
        except (PySparkException, Py4JError):
            rows.append((name, None, "unreadable"))
    return spark.createDataFrame(rows, "table_name string, rows bigint, status string")


def keyword_yield(announcements: DataFrame) -> DataFrame:
    """Rows scanned and rows that match the keyword recipe, per symbol."""
    text = F.lower(F.concat_ws(
        " ", F.coalesce("desc", F.lit("")), F.coalesce("attchmntText", F.lit(""))))
    hit = text.contains(CONCALL_KEYWORD) | text.contains(ANNUAL_REPORT_KEYWORD)
    return announcements.groupBy("symbol").agg(
        F.count("*").alias("scanned"), F.count_if(hit).alias("matched")
    )


def download_stats(downloads: DataFrame) -> DataFrame:
    """Per environment: downloads, bytes, latency and errors; ``same_bytes`` compares the
    byte totals of all environments."""
    per_env = downloads.groupBy("environment").agg(
        F.count("*").alias("downloads"),
        F.sum("bytes").alias("total_bytes"),
        F.round(F.avg("elapsed_ms"), 1).alias("avg_ms"),
        F.min("elapsed_ms").alias("min_ms"),
        F.max("elapsed_ms").alias("max_ms"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    # One row per environment: few enough to look at side by side in one row.
    side_by_side = per_env.agg(
        (F.min("total_bytes") == F.max("total_bytes")).alias("same_bytes"),
        F.collect_list(F.struct(*per_env.columns)).alias("_rows"))
    return side_by_side.select("same_bytes", F.inline("_rows")).select(
        *per_env.columns, "same_bytes")


def ingest_summary(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per symbol and in total (null symbol): documents, errors, pages, chunks and
    embedding outcomes. ``documents`` carries symbol and outcome; ``pages`` one row per
    page and ``chunks`` one status row per chunk, both with document_id."""

    def per_document(df: DataFrame, *aggs: Column) -> DataFrame:
        return df.groupBy("document_id").agg(*aggs)

    page_counts = per_document(pages, F.count("*").alias("pages"))
    status = F.col("status")
    chunk_status = per_document(
        chunks, F.count("*").alias("chunks"),
        *(F.count_if(status == s).alias(s) for s in ("embedded", "skipped", "failed")),
    )
    facts = documents.join(page_counts, "document_id", "left").join(
        chunk_status, "document_id", "left")
    sums = ("pages", "chunks", "embedded", "skipped", "failed")
    return facts.rollup("symbol").agg(
        F.count_if(F.col("outcome") != "error").alias("documents"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
    )


def list_entities(companies: DataFrame) -> DataFrame:
    """The dimension in display order."""
    return companies.select("symbol", "name", "industry").orderBy("name", "symbol")


def tracked_symbols(companies: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Sorted symbols, optionally only those named in ``subset`` in any case."""
    df = companies.select("symbol")
    if subset:
        df = df.filter(F.col("symbol").isin([s.upper() for s in subset]))
    return df.orderBy("symbol")


def _missing_keys(child: DataFrame, parent: DataFrame, child_key: str,
                  parent_key: str) -> DataFrame:
    """Child keys without a parent: keys are made distinct map-side before they are
    shuffled, so neither the child rows nor a parent with very many of them move. They are
    stored before their number decides on a broadcast, so the child is read for them once."""
    used = child.filter(F.col(child_key).isNotNull()).select(child_key).distinct()
    missing = used.join(parent, used[child_key] == parent[parent_key], "left_anti")
    return broadcast_if_small(stored(missing, "missing_keys"), MAX_KEYS)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(_missing_keys(child, parent, child_key, parent_key), child_key, "left_semi")


def retain_referenced(child: DataFrame, parent: DataFrame, child_key: str,
                      parent_key: str) -> DataFrame:
    """Child rows that survive a cascading delete of everything not in ``parent``."""
    return child.join(_missing_keys(child, parent, child_key, parent_key), child_key, "left_anti")
