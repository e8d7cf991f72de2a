"""Page text to sentences, headings and overlapping chunks.

Each page is one row and everything happens inside that row with built-in array
functions, so chunking needs no shuffle and scales with the number of pages. The
packing is a single fold whose three positions only move forward. Folds that make a list
go through their items in blocks of about the square root of their number, each with a list of
its own: appending copies a list, and so no item is copied more than twice that often. A
page may be a whole book.

Arrays are opened with the outer generators and a null filter: for the inner ones Spark
infers a filter on the array's size, which would work out the whole array twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import chunk_key, strip, strip_left, strip_right, token_count, word_set

# Chunk sizes in tokens and the heading limit in words.
TARGET_TOKENS = 800
OVERLAP_TOKENS = 100
HEADING_MAX_WORDS = 10

# Words after which a full stop does not end a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "sh", "smt", "prof", "sr", "jr", "st", "ltd", "inc", "co", "corp",
    "govt", "no", "fig", "approx", "vs", "etc", "eg", "ie", "rs", "us", "uk", "fy", "q1", "q2",
    "q3", "q4", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)

# A sentence may end between closing punctuation and whitespace that leads to a
# capital letter, a quote or a bracket.
SENTENCE_BREAK = r"(?U)(?<=[.!?])(?=\s+[A-Z\"'(])"


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(items: Column, start: Column, step: Callable[[Column, Column], Column],
          name: str) -> Column:
    """``F.aggregate`` whose state has a list ``name`` that steps append to."""

    def over(all_items: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(all_items))), F.lit(1)).cast("int")
        blocks = F.ceil(F.size(all_items) / size).cast("int")

        def block(acc: Column, at: Column) -> Column:
            inner = F.aggregate(F.slice(all_items, at * size + 1, size),
                                acc.withField(name, F.slice(acc[name], 1, 0)), step)
            return _bound(inner, lambda done: done.withField(
                name, F.concat(acc[name], done[name])))

        numbers = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(
            F.array().cast("array<int>"))
        return F.aggregate(numbers, start, block)

    return _bound(items, over)


def _pieces(text: Column) -> Column:
    """array<struct(raw, len, tok, cut, trail)> of the text between possible breaks."""
    bodies = F.transform(
        F.split(text, SENTENCE_BREAK),
        lambda piece: F.struct(piece.alias("piece"), strip_right(piece).alias("body")),
    )

    def describe(item: Column) -> Column:
        body = item["body"]
        closed = F.right(body, F.lit(1)).isin(".", "!", "?")
        last_word = F.regexp_extract(
            F.substring_index(body, " ", -1), r"(?U)(?<!\w)(\w++)[.!?]*+\z", 1
        )
        return F.struct(
            item["piece"].alias("raw"),
            F.length(item["piece"]).alias("len"),
            token_count(body).alias("tok"),
            (closed & ~F.array_contains(word_set(ABBREVIATIONS), F.lower(last_word))).alias("cut"),
            (F.length(item["piece"]) - F.length(body)).alias("trail"),
        )

    return F.transform(bodies, describe)


def _spans(pieces: Column) -> Column:
    """Joins pieces across abbreviations into struct(start, raw, rest, total, spans), where
    spans is array<struct(s, e, c, raw)> with character offsets, running token totals
    and the text; ``raw`` and ``rest`` are the text and tokens after the last full one.
    Texts are kept here, because cutting them out by offset again reads the page from
    its start each time."""
    start = F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("pos"), F.lit(0).alias("total"),
        F.lit(0).alias("rest"), F.lit("").alias("raw"),
        F.expr("cast(array() as array<struct<s:int,e:int,c:int,raw:string>>)").alias("spans"),
    )

    def step(acc: Column, piece: Column) -> Column:
        pos = acc["pos"] + piece["len"]
        total = acc["total"] + piece["tok"]
        raw = F.concat(acc["raw"], piece["raw"])
        ended = F.struct(acc["start"].alias("s"), (pos - piece["trail"]).alias("e"),
                         total.alias("c"), raw.alias("raw"))
        return F.when(piece["cut"], F.struct(
            pos.alias("start"), pos.alias("pos"), total.alias("total"), F.lit(0).alias("rest"),
            F.lit("").alias("raw"), F.concat(acc["spans"], F.array(ended)).alias("spans"),
        )).otherwise(F.struct(
            acc["start"].alias("start"), pos.alias("pos"), total.alias("total"),
            (acc["rest"] + piece["tok"]).alias("rest"), raw.alias("raw"),
            acc["spans"].alias("spans"),
        ))

    return _fold(pieces, start, step, "spans")


def _sentences(pages: DataFrame) -> DataFrame:
    """Pages with ``sents``: array<struct(s, e, c, raw)>; a trailing remainder counts as a
    sentence that starts at its first visible character."""
    tail = F.col("_fold.raw")
    remainder = F.struct(
        (F.col("_fold.start") + F.length(tail) - F.length(strip_left(tail))).alias("s"),
        (F.col("_fold.start") + F.length(strip_right(tail))).alias("e"),
        F.col("_fold.total").alias("c"),
        tail.alias("raw"),
    )
    return (
        pages.withColumn("_fold", _spans(_pieces(F.col("text"))))
        .withColumn(
            "sents",
            F.when(F.col("_fold.rest") > 0, F.concat("_fold.spans", F.array(remainder)))
            .otherwise(F.col("_fold.spans")),
        )
        .drop("_fold")
    )


def segment_sentences(pages: DataFrame) -> DataFrame:
    """One row per sentence: ordinal, character offsets and text. A sentence starts
    where the previous one ended, leading whitespace included in the offsets."""
    rows = _sentences(pages.select("document_id", "page", "text")).select(
        "document_id", "page", F.posexplode_outer("sents"))
    return rows.filter("pos IS NOT NULL").select(
        "document_id", "page", (F.col("pos") + 1).alias("ord"),
        F.col("col.s").alias("start"), F.col("col.e").alias("end"),
        strip(F.col("col.raw")).alias("sentence"),
    )


def _headings(text: Column, separator: str) -> Column:
    """array<struct(off, heading)> of short standalone blocks that read like a title."""
    start = F.struct(
        F.lit(0).alias("off"),
        F.expr("cast(array() as array<struct<off:int,heading:string>>)").alias("found"),
    )

    def step(acc: Column, block: Column) -> Column:
        title = block["title"]
        is_heading = (
            title.rlike(r"\p{L}")
            & ~title.rlike(r"\A[•\-*\t]")
            & ~title.rlike(r"[.!?]\z")
            & token_count(title).between(1, HEADING_MAX_WORDS)
        )
        row = F.struct(acc["off"].alias("off"), title.alias("heading"))
        return F.struct(
            (acc["off"] + block["len"] + len(separator)).alias("off"),
            F.when(is_heading, F.concat(acc["found"], F.array(row)))
            .otherwise(acc["found"]).alias("found"),
        )

    blocks = F.transform(
        F.split(text, separator),
        lambda b: F.struct(F.length(b).alias("len"), strip(b).alias("title")),
    )
    return _fold(blocks, start, step, "found")["found"]


def detect_headings(pages: DataFrame, separator: str = "\n\n") -> DataFrame:
    """One row per heading with its character offset on the page."""
    return pages.select(
        "document_id", "page", F.inline_outer(_headings(F.col("text"), separator))
    ).filter("off IS NOT NULL").withColumnRenamed("off", "offset")


def _packing(target: int, overlap: int) -> Column:
    """Chunk bounds array<struct(i, j)> over ``before``, the token totals at each
    sentence border. i: first sentence of the chunk; j: border after its last; k: last
    border with at least ``overlap`` tokens up to j, where the next chunk restarts."""
    n = F.col("n_sents")

    def tokens(lo: Column, hi: Column) -> Column:
        return F.get("before", hi) - F.get("before", lo)

    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("k"),
        F.expr("cast(array() as array<struct<i:int,j:int>>)").alias("out"),
    )

    def step(acc: Column, _: Column) -> Column:
        i, j, k = acc["i"], acc["j"], acc["k"]
        move_k = (k + 1 < j) & (tokens(k + 1, j) >= overlap)
        move_j = (j < n) & ((j == i) | (tokens(i, j + 1) <= target))
        next_i = F.when(j >= n, n).otherwise(F.greatest(k, i + 1))
        bounds = F.array(F.struct(i.alias("i"), j.alias("j")))

        def state(i: Column, j: Column, k: Column, out: Column) -> Column:
            return F.struct(i.alias("i"), j.alias("j"), k.alias("k"), out.alias("out"))

        return (
            F.when(i >= n, acc)
            .when(move_k, state(i, j, k + 1, acc["out"]))
            .when(move_j, state(i, j + 1, k, acc["out"]))
            .otherwise(state(next_i, j, k, F.concat(acc["out"], bounds)))
        )

    moves = F.when(n > 0, F.sequence(F.lit(1), 3 * n)).otherwise(F.array().cast("array<int>"))
    return _fold(moves, start, step, "out")["out"]


def chunk_pages(pages: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS,
                separator: str = "\n\n") -> DataFrame:
    """Pages (document_id, page, text) to chunk rows.

    Whole sentences are packed up to ``target`` tokens; the first one is taken whatever
    its size; the next chunk restarts at the trailing sentences that hold at least
    ``overlap`` tokens, always moving on by one. Chunks stay within their page.
    """
    before = F.concat(F.array(F.lit(0)), F.transform("sents", lambda s: s["c"]))
    packed = (
        _sentences(pages.select("document_id", "page", "text"))
        .withColumn("before", before)
        .withColumn("n_sents", F.size("sents"))
        .withColumn("bounds", _packing(target, overlap))
        .withColumn("headings", _headings(F.col("text"), separator))
    )

    def chunk(bound: Column) -> Column:
        start = F.get("sents", bound["i"])["s"]
        parts = F.slice("sents", bound["i"] + 1, bound["j"] - bound["i"])
        above = F.filter("headings", lambda h: h["off"] <= start)
        return F.struct(
            start.alias("start"),
            F.get(above, F.size(above) - 1)["heading"].alias("section"),
            strip(F.array_join(F.transform(parts, lambda p: p["raw"]), "")).alias("content"),
        )

    rows = packed.select("document_id", "page", F.inline_outer(F.transform("bounds", chunk)))
    return rows.filter("start IS NOT NULL").select(
        chunk_key(F.col("document_id"), F.col("page"), F.col("start")).alias("id"),
        F.col("document_id").cast("string").alias("document_id"), "page", "start", "section",
        "content", token_count(F.col("content")).alias("token_count"),
    )


def assign_sections(starts: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of form over tables: each (document_id, page, start) gets the nearest heading
    at or before it. The window partition is one page."""
    events = starts.select(
        "document_id", "page", F.col("start").alias("at"), F.lit(1).alias("kind"),
        F.lit(None).cast("string").alias("heading"),
    ).unionByName(
        headings.select(
            "document_id", "page", F.col("offset").alias("at"), F.lit(0).alias("kind"), "heading"
        )
    )
    w = Window.partitionBy("document_id", "page").orderBy("at", "kind")
    return (
        events.withColumn("section", F.last("heading", ignorenulls=True).over(w))
        .filter("kind = 1")
        .select("document_id", "page", F.col("at").alias("start"), "section")
    )
