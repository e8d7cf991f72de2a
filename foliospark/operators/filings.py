"""Discovery of filings: classify, key, deduplicate, and advance the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import filings as ff


def optional_filter(df: DataFrame, symbol: str | None = None, doc_type: str | None = None,
                    period: str | None = None) -> DataFrame:
    """Keep rows that match every filter that is set; a set filter drops null values."""
    wanted = {"symbol": symbol, "doc_type": doc_type, "period": period}
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def matches_filters() -> Column:
    """The same rule per question, as a condition over filter_* and document columns."""
    cond = F.lit(True)
    for name in ("symbol", "doc_type", "period"):
        wanted = F.col(f"filter_{name}")
        cond = cond & (wanted.isNull() | (wanted == F.col(name)))
    return cond


def in_date_window(announcements: DataFrame, to_date: Column,
                   since_days: int = ff.DEFAULT_SINCE_DAYS) -> DataFrame:
    """Announcements dated within the ``since_days`` before ``to_date``, both ends in."""
    day = F.to_date(ff.feed_time(F.col("an_dt")))
    return announcements.filter(day.between(F.date_sub(to_date, since_days), to_date))


def request_window(to_date: Column, since_days: int = ff.DEFAULT_SINCE_DAYS) -> Column:
    """struct(from_date, to_date) formatted for the feed."""
    return F.struct(
        F.date_format(F.date_sub(to_date, since_days), ff.REQUEST_DATE).alias("from_date"),
        F.date_format(to_date, ff.REQUEST_DATE).alias("to_date"),
    )


def to_filings(announcements: DataFrame) -> DataFrame:
    """Announcement rows to candidate filings: transcripts and annual reports that have
    an attachment, with their ledger key. The period is not known at this point."""
    extra = [c for c in announcements.columns
             if c not in ("symbol", "desc", "attchmntText", "attchmntFile", "seq_id")]
    return (
        announcements
        .withColumn("doc_type", ff.filing_type(F.col("desc"), F.col("attchmntText")))
        .filter(F.col("doc_type").isNotNull() & (F.length("attchmntFile") > 0))
        .select(
            *extra, "symbol", "doc_type", F.lit(None).cast("string").alias("period"),
            F.col("attchmntFile").alias("source_url"),
            ff.sequence_id(F.col("seq_id")).alias("nse_seq_id"),
        )
        .withColumn(
            "ledger_key", ff.ledger_key(F.col("nse_seq_id"), F.col("symbol"), F.col("source_url"))
        )
    )


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key. A min over structs combines map-side, so a key that
    holds a large share of all rows costs no more than any other."""
    rest = [c for c in df.columns if c not in order and c != key]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*df.columns)


def unseen_filings(announcements: DataFrame, ledger: DataFrame, order: list[str]) -> DataFrame:
    """Candidate filings whose key is not in the ledger, once per key."""
    fresh = to_filings(announcements).join(ledger.select(F.col("seen").alias("ledger_key")),
                                           "ledger_key", "left_anti")
    return first_per_key(fresh, "ledger_key", order)


def unseen_transcripts(announcements: DataFrame, ledger: DataFrame, order: list[str],
                       to_date: Column, since_days: int = 150) -> DataFrame:
    """Backfill form: transcripts only, over a bounded window."""
    windowed = in_date_window(announcements, to_date, since_days)
    return unseen_filings(windowed, ledger, order).filter(F.col("doc_type") == "concall")


def dedup_filings(filings: DataFrame, stored: DataFrame, order: list[str],
                  row_id: str = "filing_id") -> DataFrame:
    """Outcome per fetched filing: 'error', 'skipped' or 'ingested', and why.

    Checked in turn: filing id already stored, key seen earlier in this run, fetch
    error, content hash already stored, content hash seen earlier in this run. The
    winners of a key or hash are found by a combining min and joined back on the unique
    row id.
    """
    ids = stored.filter("nse_seq_id IS NOT NULL").select("nse_seq_id").distinct()
    hashes = stored.filter("sha256 IS NOT NULL").select("sha256").distinct()

    def marked(df: DataFrame, keys: DataFrame, key: str, flag: str) -> DataFrame:
        """``flag`` where the key is among ``keys``. Rows without a key, which no task could
        hold together, do not take part; a frequent key meets one row, so AQE can split it."""
        there = F.col(key).isNotNull()
        joined = df.filter(there).join(keys.withColumn(flag, F.lit(True)), key, "left")
        return joined.unionByName(df.filter(~there).withColumn(flag, F.lit(None).cast("boolean")))

    def winners(df: DataFrame, key: str, flag: str) -> DataFrame:
        first = F.min_by(row_id, F.struct(*order)).alias(row_id)
        return df.groupBy(key).agg(first).select(row_id, F.lit(True).alias(flag))

    by_key = filings.join(winners(filings, "ledger_key", "_first_key"), row_id, "left")
    by_key = marked(by_key, ids, "nse_seq_id", "_hit")
    by_key = by_key.withColumn(
        "_reason",
        F.when(F.col("_hit"), F.lit("filing_id"))
        .when(F.col("_first_key").isNull(), F.lit("repeated_key"))
        .when(F.col("error").isNotNull(), F.lit("fetch_error")),
    ).drop("_hit")
    fetched = by_key.filter("_reason IS NULL")
    new_hash = fetched.select(row_id, "sha256", *order).join(hashes, "sha256", "left_anti")
    kept = winners(new_hash, "sha256", "_first_hash")
    reason = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("_first_hash"), F.lit("new"))
        .when(F.col("_known"), F.lit("content_hash"))
        .otherwise(F.lit("repeated_content"))
    )
    outcome = (
        F.when(F.col("reason") == "new", F.lit("ingested"))
        .when(F.col("reason") == "fetch_error", F.lit("error"))
        .otherwise(F.lit("skipped"))
    )
    return (
        marked(by_key.join(kept, row_id, "left"), hashes, "sha256", "_known")
        .withColumn("reason", reason).withColumn("outcome", outcome)
        .select(*filings.columns, "outcome", "reason")
    )


def advance_ledger(ledger: DataFrame, outcomes: DataFrame, failed_embeddings: int) -> DataFrame:
    """The next ledger: skipped filings are always seen, ingested ones only when every
    embedding of the run landed, failed downloads never."""
    done = ["skipped", "ingested"] if failed_embeddings == 0 else ["skipped"]
    newly = outcomes.filter(F.col("outcome").isin(done)).select(F.col("ledger_key").alias("seen"))
    return ledger.select("seen").unionByName(newly).distinct()


def annual_report_rows(reports: DataFrame) -> DataFrame:
    """Structured annual-report rows to filings with a fiscal period and file kind."""
    return reports.select(
        "symbol", F.lit("annual_report").alias("doc_type"),
        ff.fiscal_period(F.col("fromYr"), F.col("toYr")).alias("period"),
        F.col("fileName").alias("source_url"),
        ff.file_kind(F.col("fileName")).alias("file_kind"),
    )
