"""Layout blocks to page text: reading order, margin stripping, assembly.

Every group here is one page, which bounds its size; a document is never a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import repeat_key, token_count

# Margin band in points, short-block words, column rule.
MARGIN_BAND = 45
SHORT_BLOCK_WORDS = 12
MIN_COLUMN_BLOCKS = 3
MIDLINE_SLACK = 0.02

PAGE_KEY = ("document_id", "page")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds ``two_column`` and ``ord`` (1-based position on the page).

    A page has two columns when no block crosses the midline and both sides have
    enough blocks; it then reads left side before right, each from the top.
    Half-even rounding of y groups the blocks of one text line.
    """
    page = Window.partitionBy(*PAGE_KEY)
    mid = F.col("page_width") / 2
    slack = F.col("page_width") * MIDLINE_SLACK
    right = (F.col("x0") + F.col("x1")) / 2 >= mid
    crossing = (F.col("x0") < mid - slack) & (F.col("x1") > mid + slack)
    two_column = (
        ~F.bool_or(crossing).over(page)
        & (F.count_if(~right).over(page) >= MIN_COLUMN_BLOCKS)
        & (F.count_if(right).over(page) >= MIN_COLUMN_BLOCKS)
    )
    major = F.when(F.col("two_column"), right.cast("double")).otherwise(F.bround("y0", 0))
    minor = F.when(F.col("two_column"), F.col("y0")).otherwise(F.col("x0"))
    order = page.orderBy(major, minor, "x0", "y0", "y1", "text")
    return blocks.withColumn("two_column", two_column).withColumn(
        "ord", F.row_number().over(order)
    )


def strip_margins(blocks: DataFrame) -> DataFrame:
    """Adds ``kept``: false for short blocks inside the top or bottom band, and for
    longer ones there whose repeat key is on two or more pages of the document.

    Only long margin blocks are shuffled to be counted. The way back is joined on
    (document, page, key), so that no document or footer becomes a hot join key.
    """
    in_margin = (F.col("y1") <= MARGIN_BAND) | (F.col("y0") >= F.col("page_height") - MARGIN_BAND)
    short = token_count(F.col("text")) <= SHORT_BLOCK_WORDS
    marked = blocks.withColumn("_short", in_margin & short).withColumn(
        "_key", F.when(in_margin & ~short, repeat_key(F.col("text")))
    )
    candidates = marked.filter("_key IS NOT NULL").select(*PAGE_KEY, "_key").distinct()
    repeated = candidates.groupBy("document_id", "_key").agg(F.count("*").alias("_pages"))
    drop = candidates.join(repeated.filter("_pages >= 2"), ["document_id", "_key"]).select(
        *PAGE_KEY, "_key", F.lit(True).alias("_repeats")
    )
    return marked.join(drop, [*PAGE_KEY, "_key"], "left").select(
        *blocks.columns,
        (~F.col("_short") & F.col("_repeats").isNull()).alias("kept"),
    )


def assemble_pages(ordered: DataFrame, page_list: DataFrame | None = None) -> DataFrame:
    """Kept blocks of each page joined by a blank line. A page whose blocks were all
    dropped keeps an empty row; ``page_list`` adds the pages that had no blocks."""
    parts = F.sort_array(F.collect_list(F.when(F.col("kept"), F.struct("ord", "text"))))
    pages = ordered.groupBy(*PAGE_KEY).agg(
        F.array_join(F.transform(parts, lambda b: b["text"]), "\n\n").alias("text")
    )
    if page_list is None:
        return pages
    return (
        page_list.select(*PAGE_KEY).distinct().join(pages, list(PAGE_KEY), "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
    )


def extract_pages(blocks: DataFrame, page_list: DataFrame | None = None) -> DataFrame:
    return assemble_pages(reading_order(strip_margins(blocks)), page_list)
