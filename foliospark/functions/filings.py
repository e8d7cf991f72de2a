"""Column helpers over filing and announcement rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip

# The keyword recipe and the feed's date formats.
CONCALL_KEYWORD = "transcript"
ANNUAL_REPORT_KEYWORD = "annual report"
FEED_TIMESTAMP = "dd-MMM-yyyy HH:mm:ss"
REQUEST_DATE = "dd-MM-yyyy"
DEFAULT_SINCE_DAYS = 7


def filing_type(desc: Column, text: Column) -> Column:
    """'concall', 'annual_report' or null; a transcript mention wins."""
    words = F.lower(F.concat_ws(" ", F.coalesce(desc, F.lit("")), F.coalesce(text, F.lit(""))))
    return F.when(words.contains(CONCALL_KEYWORD), F.lit("concall")).when(
        words.contains(ANNUAL_REPORT_KEYWORD), F.lit("annual_report")
    )


def sequence_id(raw: Column) -> Column:
    """The feed's filing id as a long; null unless it is all digits."""
    digits = strip(raw)
    return F.when(digits.rlike(r"\A[0-9]+\z"), digits.try_cast("bigint"))


def ledger_key(seq_id: Column, symbol: Column, url: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("seq:"), seq_id.cast("string")), F.concat(symbol, F.lit("|"), url)
    )


def file_name(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "/", -1)


def object_path(symbol: Column, doc_type: Column, url: Column) -> Column:
    return F.concat_ws("/", symbol, doc_type, file_name(url))


def citation_label(symbol: Column, doc_type: Column, period: Column, url: Column) -> Column:
    """``symbol doc_type (period) — url``; the period part only when there is one."""
    part = F.coalesce(F.concat(F.lit(" ("), period, F.lit(")")), F.lit(""))
    return F.concat(symbol, F.lit(" "), doc_type, part, F.lit(" — "), url)


def page_link(url: Column, page: Column) -> Column:
    return F.when(
        page.isNotNull(), F.concat(url, F.lit("#page="), page.cast("string"))
    ).otherwise(url)


def doc_type_label(doc_type: Column) -> Column:
    words = F.replace(doc_type, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))


def or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("n/a"))


def feed_time(an_dt: Column) -> Column:
    return F.try_to_timestamp(an_dt, F.lit(FEED_TIMESTAMP))


def fiscal_period(from_year: Column, to_year: Column) -> Column:
    """``FY2025-26`` from the structured year fields."""
    return F.concat(
        F.lit("FY"), from_year.cast("string"), F.lit("-"),
        F.right(to_year.cast("string"), F.lit(2)),
    )


def file_kind(url: Column) -> Column:
    name = F.lower(file_name(url))
    return F.when(name.endswith(".pdf"), F.lit("pdf")).when(name.endswith(".zip"), F.lit("zip"))
