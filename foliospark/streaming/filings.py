"""Watching landed feed files for filings not seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.functions.filings import feed_time
from foliospark.operators.filings import first_per_key, to_filings
from foliospark.sources.feeds import PAYLOAD, parse_announcements
from foliospark.sources.ledger import read_ledger_table
from foliospark.sources.tables import append_version, earlier_versions, run_of

FILING = ("symbol string, doc_type string, period string, source_url string, "
          "nse_seq_id bigint, ledger_key string, an_ts timestamp")


def landed_announcements(spark: SparkSession, path: str) -> DataFrame:
    """Stream of announcement rows from payload files as they land."""
    return parse_announcements(spark.readStream.schema(PAYLOAD).json(path))


def stream_new_filings(announcements: DataFrame, out_path: str, checkpoint: str,
                       ledger_path: str | None = None) -> StreamingQuery:
    """Writes each new filing once to a versioned table at ``out_path``.

    Repeats inside a batch are reduced to the earliest row; everything stored before, or
    named by the imported ledger, is taken out by an anti-join on the key column. That
    holds for filings of any age, so late files lose nothing to a watermark. A batch is
    one version of its run: a retried batch replaces itself instead of adding rows.
    """
    found = to_filings(announcements.withColumn("an_ts", feed_time(F.col("an_dt")))).drop("an_dt")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_of(spark, checkpoint)
        earlier = earlier_versions(spark, out_path, FILING, run, batch_id)
        seen = earlier.select("ledger_key")
        if ledger_path:
            imported = read_ledger_table(spark, ledger_path)
            seen = seen.unionByName(imported.select(F.col("seen").alias("ledger_key")))
        new = first_per_key(batch, "ledger_key", ["an_ts", "source_url"]).join(
            seen, "ledger_key", "left_anti")
        append_version(new, out_path, batch_id, run)

    return (
        found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
