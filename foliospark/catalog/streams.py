"""Registered queries: the streaming jobs run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.answers import FOLD_SQL, _events
from foliospark.catalog.corpus import ADMIT_SQL, UNSEEN
from foliospark.catalog.inputs import INPUTS, Tables, query
from foliospark.catalog.text import letter_profile
from foliospark.functions import filings as ff
from foliospark.plans import discovery
from foliospark.session import shared_folder, stored
from foliospark.sources import ledger, tables
from foliospark.streaming import admission, answers, embed, filings


def _stream(t: Tables, name: str) -> DataFrame:
    """A driver table as a file stream. The table is one file or a folder of files; a pattern
    that only its name fits lets Spark's file source take either."""
    return t.spark.readStream.schema(t(name).schema).parquet(f"{t.folder}/{name}.parque[t]")


def _derived_stream(t: Tables, name: str, table: str) -> DataFrame:
    return t.spark.sql(INPUTS[name], **{table: _stream(t, table)})


@query("stream_new_filings", f"""WITH k AS (SELECT 1), {UNSEEN}
SELECT symbol, doc_type, source_url, nse_seq_id, ledger_key FROM fresh WHERE nth = 1""")
def _stream_new_filings(t: Tables):
    out, seen = shared_folder(t.spark, "filings"), shared_folder(t.spark, "ledger")
    ledger.write_ledger(t("ledger"), seen)
    feed = _derived_stream(t, "announcements", "events").withColumn(
        "an_dt", F.date_format("ts", ff.FEED_TIMESTAMP)).drop("ts", "event_id")
    filings.stream_new_filings(
        feed, out, shared_folder(t.spark, "checkpoint"), seen).awaitTermination()
    stored = tables.read_versions(t.spark, out, filings.FILING)
    return stored.select("symbol", "doc_type", "source_url", "nse_seq_id", "ledger_key")


@query("discovery_runs", f"""WITH k AS (SELECT 1), {UNSEEN},
  fetched AS (
    SELECT f.*, {{sha_of_text}} AS sha256 FROM fresh f
    LEFT JOIN {{documents}} d ON f.source_url = 'https://feed.example.org/corporate/f'
      || CAST(d.doc_id AS STRING) || '.pdf?dl=1' WHERE nth = 1),
  judged AS (
    SELECT ledger_key, CASE WHEN sha256 IS NULL THEN 'error'
      WHEN row_number() OVER (PARTITION BY sha256 ORDER BY date_trunc('second', ts), source_url) = 1
      THEN 'ingested' ELSE 'skipped' END AS outcome
    FROM fetched)
SELECT ledger_key, outcome, outcome = 'skipped' AS seen_first, outcome <> 'error' AS seen_second,
  outcome = 'ingested' AS stored FROM judged""")
def _discovery_runs(t: Tables):
    """Announcements as a stream of finds, settled twice: with an embedder that fails, which
    holds back what is new, and then with one that works."""
    spark, base = t.spark, shared_folder(t.spark, "discovery")
    held = discovery.DiscoveryTables(base)
    tables.append_version(t("ledger"), held.ledger, 0, "import")
    feed = _derived_stream(t, "announcements", "events").withColumn(
        "an_dt", F.date_format("ts", ff.FEED_TIMESTAMP)).drop("ts", "event_id")
    imported = shared_folder(spark, "ledger")
    ledger.write_ledger(t("ledger"), imported)
    filings.stream_new_filings(
        feed, held.found, shared_folder(spark, "checkpoint"), imported).awaitTermination()
    url = "https://feed.example.org/corporate/f"
    texts = t("documents").select(
        F.concat(F.lit(url), F.col("doc_id").cast("string"), F.lit(".pdf?dl=1")).alias("source_url"),
        "text")

    def fetch(pending: DataFrame) -> DataFrame:
        return pending.join(texts, "source_url", "left").withColumns({
            "sha256": F.sha2("text", 256),
            "error": F.when(F.col("text").isNull(), F.lit("HTTP 404"))})

    def failing(texts: list[str]) -> list[list[float]]:
        raise RuntimeError("down")

    first, _ = discovery.settle(spark, held, fetch, failing, "letters", "first", "\n", backoff=0)
    seen_first = held.read_ledger(spark).select(F.col("seen").alias("ledger_key"), F.lit(True).alias("a"))
    seen_first = stored(seen_first, "seen")
    discovery.settle(spark, held, fetch, letter_profile, "letters", "second", "\n", backoff=0)
    seen = held.read_ledger(spark).select(F.col("seen").alias("ledger_key"), F.lit(True).alias("b"))
    kept = tables.read_versions(spark, held.documents, discovery.DOCUMENT).select(
        "ledger_key", F.lit(True).alias("c"))
    out = first.select("ledger_key", "outcome")
    for flag in (seen_first, seen, kept):
        out = out.join(flag, "ledger_key", "left")
    return out.select("ledger_key", "outcome", *(F.coalesce(c, F.lit(False)).alias(n) for c, n in (
        ("a", "seen_first"), ("b", "seen_second"), ("c", "stored"))))


@query("stream_admission", ADMIT_SQL)
def _stream_admission(t: Tables):
    """The requests in two runs with a checkpoint each, the first half of the time in the first;
    the usage is compacted between them."""
    out, usage = shared_folder(t.spark, "decisions"), shared_folder(t.spark, "usage")
    half = t("events").agg(F.percentile_approx("ts", 0.5)).first()[0]
    for early in (True, False):
        requests = _derived_stream(t, "requests", "events")
        requests = requests.filter(F.col("ts") <= F.lit(half) if early else F.col("ts") > F.lit(half))
        admission.stream_admission(
            requests, out, usage, shared_folder(t.spark, "checkpoint"), 5).awaitTermination()
        admission.compact_usage(t.spark, usage)
        tables.vacuum(t.spark, usage)
    decided = tables.read_versions(
        t.spark, out, "ip string, ts timestamp, id bigint, day date, used bigint, allowed boolean")
    return decided.select("id", "ip", F.col("day").cast("string").alias("day"), "used", "allowed")


@query("stream_daily_usage", """
SELECT ip, CAST(CAST(ts AS DATE) AS STRING) AS day, count(*) AS count FROM {requests} GROUP BY ALL""")
def _stream_daily_usage(t: Tables):
    """Running counts in update mode; the last update of each (ip, day) stands."""
    out, checkpoint = shared_folder(t.spark, "daily"), shared_folder(t.spark, "checkpoint")
    requests = _derived_stream(t, "requests", "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, batch_id: int) -> None:
        tables.append_version(batch.withColumn("key", F.concat_ws("|", "ip", "day")), out, batch_id,
                              tables.run_of(batch.sparkSession, checkpoint))

    (
        admission.daily_usage_stream(requests).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    current = tables.read_current(
        t.spark, out, "ip string, day date, count bigint, key string", "key")
    return current.select("ip", F.col("day").cast("string").alias("day"), "count")


@query("stream_embed", """
SELECT CAST(doc_id AS STRING) AS document_id, doc_id % 2 = 0 AS in_first_run,
  CAST(1 AS BIGINT) AS runs, CAST(0 AS BIGINT) AS repeated FROM {documents}
WHERE regexp_matches(text, '\\S') GROUP BY ALL""")
def _stream_embed(t: Tables):
    """Every other document streamed into chunks and vectors, then all of them with a new
    checkpoint: the second run keeps the first one's rows and embeds none of them again."""
    store = shared_folder(t.spark, "store")
    runs = []
    for wanted in ("CAST(document_id AS BIGINT) % 2 = 0", "true"):
        pages = _derived_stream(t, "doc_pages", "documents").filter(wanted).repartition(
            t.spark.sparkContext.defaultParallelism)
        checkpoint = shared_folder(t.spark, "checkpoint")
        embed.stream_embed(pages, store, checkpoint, letter_profile, "letters", separator="\n",
                           backoff=0).awaitTermination()
        runs.append(tables.run_of(t.spark, checkpoint))
    stored = tables.read_versions(t.spark, store, embed.STORED)
    return stored.filter("status = 'embedded' AND embedding IS NOT NULL") \
        .groupBy("document_id").agg(
            (F.max("run") == runs[0]).alias("in_first_run"),
            F.count_distinct("run").alias("runs"),
            (F.count("*") - F.count_distinct("id")).alias("repeated"))


@query("stream_answers", f"""WITH {FOLD_SQL}
SELECT request_id, CAST(n_sources AS BIGINT) AS n_sources, answer, refused, error,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN finished THEN 'done' ELSE 'interrupted' END AS outcome
FROM folded""")
def _stream_answers(t: Tables):
    """Event lines landed as files and folded as a stream, one file a batch. A request ends when
    the watermark has passed its closing event, or its timeout."""
    landed, out = shared_folder(t.spark, "events"), shared_folder(t.spark, "answers")
    stamped = _events(t).withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.least("seq", F.lit(3000))))
    # Three files, the closing events in the first: the order of arrival is not that of seq.
    file = F.when(F.col("type").isin("done", "error"), 0).otherwise(1 + F.col("seq") % 2)
    # A last event of another day, of a request that stays open, moves the watermark on.
    tick = stamped.limit(1).withColumns({
        "request_id": F.lit("tick"), "type": F.lit("tick"),
        "ts": F.timestamp_seconds(F.lit(1_700_100_000))})
    for n in range(4):
        part = stamped.filter(file == n) if n < 3 else tick
        answers.event_columns(part).coalesce(1).write.mode("append").parquet(landed)
    lines = t.spark.readStream.schema(
        "request_id string, seq bigint, type string, n_sources int, text string, "
        "refused boolean, error string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(landed)
    (
        answers.stream_answers(lines, lateness="1 hour").writeStream.outputMode("append").format("parquet")
        .option("path", out).option("checkpointLocation", shared_folder(t.spark, "checkpoint"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return t.spark.read.schema(answers.FOLDED).parquet(out)
