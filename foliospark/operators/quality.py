"""Extraction-quality flags for pages and whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import solid_length

# The limits and wordings of the two flags.
MIN_PAGE_CHARS = 20
MAX_GARBLE_RATIO = 0.02
MIN_DOC_CHARS = 2000
NEAR_EMPTY = "near-empty (image/scan/chart page)"
GARBAGE = "font/encoding garbage (cid or replacement chars)"


def flag_low_quality_pages(pages: DataFrame) -> DataFrame:
    """Pages with hardly any text, or with font/encoding debris. Dense tables pass."""
    measured = pages.select(
        "document_id", "page",
        solid_length(F.col("text")).alias("chars"),
        F.regexp_count("text", F.lit(r"\(cid:\d+\)")).alias("cid"),
        F.regexp_count("text", F.lit("�")).alias("garbled"),
    )
    reason = F.when(F.col("chars") < MIN_PAGE_CHARS, F.lit(NEAR_EMPTY)).when(
        (F.col("cid") > 0) | (F.col("garbled") / F.col("chars") > MAX_GARBLE_RATIO),
        F.lit(GARBAGE),
    )
    detail = F.when(
        F.col("chars") < MIN_PAGE_CHARS, F.concat(F.col("chars"), F.lit(" chars"))
    ).otherwise(
        F.concat(F.col("cid"), F.lit(" cid marker(s), "), F.col("garbled"),
                 F.lit(" replacement char(s)"))
    )
    return (
        measured.withColumn("reason", reason).filter("reason IS NOT NULL")
        .select("document_id", "page", "reason", detail.alias("detail"))
    )


def flag_thin_documents(pages: DataFrame, min_chars: int = MIN_DOC_CHARS) -> DataFrame:
    """Documents whose pages together hold too little text to be the real thing."""
    return (
        pages.select("document_id", solid_length(F.col("text")).alias("chars"))
        .groupBy("document_id")
        .agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
        .filter(F.col("chars") < min_chars)
    )
