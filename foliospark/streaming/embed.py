"""Embedding new pages as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators.chunking import OVERLAP_TOKENS, TARGET_TOKENS, chunk_pages
from foliospark.operators.embedding import Embedder, embed_batches, pending_chunks
from foliospark.sources.tables import append_version, earlier_versions, run_of

STORED = ("id string, document_id string, page int, start int, section string, content string, "
          "token_count int, embedding array<float>, embedding_provider string, status string, "
          "error string")


def stream_embed(pages: DataFrame, store_path: str, checkpoint: str, embedder: Embedder,
                 provider: str, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
                 separator: str = "\n\n", backoff: float = 5.0) -> StreamingQuery:
    """pages -> chunks -> only those still pending -> embedded -> one version per run and batch.

    Failed chunks are stored without a vector, so the next batch that brings their page,
    or ``retry_failed``, embeds them; chunk ids make every step repeatable.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        earlier = earlier_versions(spark, store_path, STORED, run, batch_id)
        chunks = chunk_pages(batch, target, overlap, separator).dropDuplicates(["id"])
        todo = pending_chunks(chunks, earlier, provider)
        append_version(embed_batches(todo, embedder, provider, backoff=backoff),
                       store_path, batch_id, run)

    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def retry_failed(store: DataFrame, embedder: Embedder, provider: str,
                 backoff: float = 5.0) -> DataFrame:
    """Embeds what is stored without a vector; append the result as a new version."""
    columns = ["id", "document_id", "page", "start", "section", "content", "token_count"]
    waiting = store.filter("embedding IS NULL").select(*columns)
    return embed_batches(waiting, embedder, provider, backoff=backoff)
