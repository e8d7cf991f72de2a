"""Discovery runs: find, fetch, deduplicate, embed, and advance the ledger.

A run has two phases. Finding writes new filings down and reads no document. Settling takes all
found filings that the ledger does not hold, whichever run found them; the ledger takes them in
only when their chunks are embedded, so what a failing embedder leaves is settled by the next run.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.filings import DEFAULT_SINCE_DAYS
from foliospark.operators.embedding import Embedder, embed_pending
from foliospark.operators.filings import (
    advance_ledger, dedup_filings, in_date_window, unseen_filings,
)
from foliospark.plans.ingest import STORED_COLUMNS, chunks_to_store
from foliospark.session import stored
from foliospark.sources.ledger import LEDGER
from foliospark.sources.tables import append_version, read_versions
from foliospark.streaming.filings import FILING

DOCUMENT = ("id string, symbol string, doc_type string, period string, source_url string, "
            "nse_seq_id bigint, sha256 string, ledger_key string")
CHUNK = ("id string, document_id string, page int, section string, content string, "
         "token_count int, embedding array<float>, embedding_provider string, status string, "
         "error string")

#: Pending filings (FILING and filing_id) to the same rows with sha256, text and error of what was
#: fetched; one row each, an error where nothing came.
Fetch = Callable[[DataFrame], DataFrame]


def discover(announcements: DataFrame, ledger: DataFrame, to_date: Column,
             order: list[str], since_days: int = DEFAULT_SINCE_DAYS) -> DataFrame:
    """Filings of the window that the ledger does not know."""
    return unseen_filings(in_date_window(announcements, to_date, since_days), ledger, order)


class DiscoveryTables:
    """Folders of the versioned tables of discovery."""

    def __init__(self, base: str):
        self.found, self.ledger = f"{base}/found", f"{base}/ledger"
        self.documents, self.chunks = f"{base}/documents", f"{base}/chunks"

    def read_ledger(self, spark: SparkSession) -> DataFrame:
        return read_versions(spark, self.ledger, LEDGER).select("seen").distinct()


def find(announcements: DataFrame, tables: DiscoveryTables, order: list[str],
         run: str | None = None) -> None:
    """Writes the announced filings down that are neither found nor seen yet (the stream of
    filings does the same, batch by batch)."""
    spark = announcements.sparkSession
    known = tables.read_ledger(spark).unionByName(
        read_versions(spark, tables.found, FILING).select(F.col("ledger_key").alias("seen")))
    new = unseen_filings(announcements, known.distinct(), order)
    append_version(new.select(*(c.split()[0] for c in FILING.split(", "))), tables.found, 0,
                   run or uuid.uuid4().hex)


def settle(spark: SparkSession, tables: DiscoveryTables, fetch: Fetch, embedder: Embedder,
           provider: str, run: str | None = None, separator: str = "\n\n",
           **settings) -> tuple[DataFrame, dict[str, int]]:
    """(outcomes, counts of the embedding run) of all found filings that the ledger lacks.

    Outcomes are those of ``dedup_filings``. Chunks are written first, vectors or not, then
    documents and ledger, these two only when no chunk failed; skipped filings are seen in
    any case and fetch errors never. A run that ends anywhere in between can be repeated: chunk
    ids keep what is embedded, stored documents are skipped by id or content.
    """
    run = run or uuid.uuid4().hex
    pending = read_versions(spark, tables.found, FILING).drop("run", "version", "seq").join(
        tables.read_ledger(spark), F.col("ledger_key") == F.col("seen"), "left_anti")
    fetched = stored(fetch(pending.withColumn("filing_id", F.col("ledger_key"))), "fetched")
    known = read_versions(spark, tables.documents, DOCUMENT)
    outcomes = stored(dedup_filings(fetched.drop("text"), known.select("nse_seq_id", "sha256"),
                                    ["an_ts", "source_url"]), "outcomes")
    new = outcomes.filter("outcome = 'ingested'")
    pages = new.select("filing_id").join(fetched, "filing_id").select(
        F.col("filing_id").alias("document_id"), F.lit(1).alias("page"), "text")
    chunks = stored(chunks_to_store(pages, separator=separator).select(*STORED_COLUMNS), "chunks")
    held = read_versions(spark, tables.chunks, CHUNK)
    counts = embed_pending(chunks, held, embedder, provider,
                           lambda rows: append_version(rows, tables.chunks, 0, run), **settings)
    if not counts["failed"]:
        append_version(new.select(
            F.col("filing_id").alias("id"), "symbol", "doc_type", "period", "source_url",
            "nse_seq_id", "sha256", "ledger_key"), tables.documents, 0, run)
    before = tables.read_ledger(spark)
    now = advance_ledger(before, outcomes, counts["failed"]).join(before, "seen", "left_anti")
    append_version(now, tables.ledger, 0, run)
    return outcomes, counts
