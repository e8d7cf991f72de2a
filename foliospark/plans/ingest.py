"""Blocks or pages to stored, embedded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import uuid5
from foliospark.operators.chunking import OVERLAP_TOKENS, TARGET_TOKENS, chunk_pages
from foliospark.operators.embedding import Embedder, embed_pending
from foliospark.operators.layout import extract_pages
from foliospark.session import shared_folder
from foliospark.session import stored as write_table

STORED_COLUMNS = ("id", "document_id", "page", "section", "content", "token_count")


def chunks_to_store(pages: DataFrame, target: int = TARGET_TOKENS,
                    overlap: int = OVERLAP_TOKENS, separator: str = "\n\n") -> DataFrame:
    """Chunk rows under their stored (uuid) ids."""
    chunks = chunk_pages(pages, target, overlap, separator)
    return chunks.withColumn("id", uuid5(F.col("id"))).select(*STORED_COLUMNS)


def ingest(pages: DataFrame, stored: DataFrame, embedder: Embedder, provider: str,
           target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
           separator: str = "\n\n", backoff: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(written, statuses): newly embedded rows, and one status row per chunk
    ('embedded', 'failed' or 'skipped').

    The embedder is the costly step, so its output is written to the shared folder once
    and both results read that table.
    """
    # Written once: the embedder and the statuses both start from it.
    chunks = write_table(chunks_to_store(pages, target, overlap, separator), "chunks")
    path = shared_folder(pages.sparkSession, "embedded")
    embed_pending(chunks, stored, embedder, provider, lambda rows: rows.write.parquet(path),
                  backoff=backoff)
    done = pages.sparkSession.read.parquet(path)
    statuses = chunks.select("id", "document_id").join(
        done.select("id", "status"), "id", "left").withColumn(
        "status", F.coalesce("status", F.lit("skipped")))
    return done.filter("status = 'embedded'").drop("status", "error"), statuses


def ingest_blocks(blocks: DataFrame, stored: DataFrame, embedder: Embedder, provider: str,
                  **settings) -> tuple[DataFrame, DataFrame]:
    return ingest(extract_pages(blocks), stored, embedder, provider, **settings)
