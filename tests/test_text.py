"""Chunking invariants, layout and quality rules on small fixtures."""

import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark import schemas
from foliospark.functions import text as ft
from foliospark.operators import chunking, layout, quality

SENTENCE = " ".join(["word"] * 18)


def filler(n):
    return " ".join(f"S{i} {SENTENCE}." for i in range(n))


def chunks_of(spark, text, **kw):
    pages = spark.createDataFrame([("doc-1", 1, text)], schemas.PAGE)
    return chunking.chunk_pages(pages, **kw).orderBy("start").collect()


def sentences_of(spark, text):
    pages = spark.createDataFrame([("d", 1, text)], schemas.PAGE)
    return [(r["start"], r["end"], r["sentence"])
            for r in chunking.segment_sentences(pages).orderBy("ord").collect()]


def test_sizes_and_overlap(spark):
    rows = chunks_of(spark, filler(120))
    assert len(rows) > 1
    assert all(r["token_count"] <= 800 for r in rows)
    assert all(r["token_count"] > 700 for r in rows[:-1])
    for a, b in zip(rows, rows[1:]):
        tail = re.findall(r"S\d+", a["content"])
        head = re.findall(r"S\d+", b["content"])
        shared = [s for s in tail if s in head]
        assert shared == tail[-len(shared):] == head[:len(shared)]
        assert len(shared) * 19 >= 100 > (len(shared) - 1) * 19
    assert all(r["content"].endswith(".") for r in rows)
    assert len({r["id"] for r in rows}) == len(rows)


def test_long_sentence_stays_whole(spark):
    rows = chunks_of(spark, "Short one. " + " ".join(["run"] * 1000) + ". Last one.")
    assert any(r["token_count"] >= 1000 for r in rows)
    assert rows[-1]["content"].endswith("Last one.")


def test_packing_matches_a_direct_restatement(spark):
    """The fold against a plain loop over random sentence sizes."""
    import random

    rng = random.Random(7)
    for target, overlap in ((50, 10), (20, 0), (30, 60), (15, 14)):
        sizes = [rng.choice([1, 2, 5, 9, 14, 33, 70]) for _ in range(60)]
        text = " ".join("X" + "x " * (n - 1) + "z." if n > 1 else "Xz." for n in sizes)
        sentences = sentences_of(spark, text)
        tokens = [len(s[2].split()) for s in sentences]
        want, i = [], 0
        while True:
            j = i + 1
            while j < len(tokens) and sum(tokens[i:j + 1]) <= target:
                j += 1
            want.append((sentences[i][0], sum(tokens[i:j])))
            if j == len(tokens):
                break
            fits = [k for k in range(i, j) if sum(tokens[k:j]) >= overlap]
            i = max(max(fits, default=i), i + 1)
        got = [(r["start"], r["token_count"])
               for r in chunks_of(spark, text, target=target, overlap=overlap)]
        assert got == want


def test_sentence_breaks(spark):
    got = sentences_of(spark, "Mr. Rao spoke. It cost Rs.54,000 (approx. Half). \"Yes!\" Fine? ok")
    assert [s for _, _, s in got] == [
        "Mr. Rao spoke.", "It cost Rs.54,000 (approx. Half).", "\"Yes!\" Fine? ok"]
    assert got[1][0] == len("Mr. Rao spoke.")
    assert sentences_of(spark, "  \n ") == []
    assert sentences_of(spark, "One. Two no stop  ")[-1] == (5, 16, "Two no stop")
    assert sentences_of(spark, "Ends with Ltd.") == [(0, 14, "Ends with Ltd.")]


def test_headings_and_sections(spark):
    body = filler(60)
    text = f"Chairman's letter\n\n{body}\n\n• bullet point\n\nNot a heading.\n\n12 34\n\nRisk factors\n\n{body}"
    pages = spark.createDataFrame([("d", 1, text)], schemas.PAGE)
    found = [r["heading"] for r in chunking.detect_headings(pages).orderBy("offset").collect()]
    assert found == ["Chairman's letter", "Risk factors"]
    rows = chunks_of(spark, text)
    assert rows[0]["section"] == "Chairman's letter"
    assert rows[-1]["section"] == "Risk factors"
    assert chunks_of(spark, "no heading here. " + body)[0]["section"] is None


def test_pages_do_not_mix(spark):
    pages = spark.createDataFrame([("d", 1, "One page."), ("d", 2, "Two page."), ("d", 3, " ")],
                                  schemas.PAGE)
    rows = chunking.chunk_pages(pages).orderBy("page").collect()
    assert [(r["page"], r["content"]) for r in rows] == [(1, "One page."), (2, "Two page.")]


def test_golden_keys(spark):
    row = spark.range(1).select(
        ft.chunk_key(F.lit("00000000-0000-0000-0000-000000000000"), F.lit(1), F.lit(0)).alias("k"),
        ft.uuid5(F.lit("abc123")).alias("u")).first()
    assert row["k"] == "34398bf144eb30c6ec41a59354b762ac8f0f0117eb3bf382cf986fa0bf17b95d"
    assert row["u"] == str(uuid.uuid5(uuid.UUID(ft.CHUNK_NAMESPACE), "abc123"))
    assert hashlib.sha256(b"doc-1|3|42").hexdigest() == spark.range(1).select(
        ft.chunk_key(F.lit("doc-1"), F.lit(3), F.lit(42))).first()[0]


def block(page, x0, y0, x1, y1, text, doc="d"):
    return (doc, page, 600.0, 800.0, float(x0), float(y0), float(x1), float(y1), text)


def ordered(spark, blocks):
    df = layout.reading_order(spark.createDataFrame(blocks, schemas.BLOCK))
    return [r["text"] for r in df.orderBy("page", "ord").collect()]


def test_two_columns(spark):
    left = [block(1, 40, y, 280, y + 20, f"L{y}") for y in (300, 100, 200)]
    right = [block(1, 320, y, 560, y + 20, f"R{y}") for y in (150, 350, 250)]
    assert ordered(spark, right + left) == ["L100", "L200", "L300", "R150", "R250", "R350"]


def test_too_few_blocks_or_a_crossing_one_fall_back(spark):
    few = [block(1, 40, 100, 280, 120, "L1"), block(1, 320, 100.4, 560, 120, "R1"),
           block(1, 40, 200, 280, 220, "L2"), block(1, 320, 200, 560, 220, "R2")]
    assert ordered(spark, few) == ["L1", "R1", "L2", "R2"]
    crossing = [block(1, 40, y, 280, y + 9, f"L{y}") for y in (100, 200, 300)]
    crossing += [block(1, 320, y, 560, y + 9, f"R{y}") for y in (100, 200, 300)]
    crossing += [block(1, 100, 50, 500, 60, "Title")]
    assert ordered(spark, crossing)[:3] == ["Title", "L100", "R100"]


def test_margins(spark):
    footer = "Forward looking statements apply to this document as of the date printed on page {}"
    blocks = [
        block(1, 40, 10, 100, 30, "Running title"), block(1, 40, 50, 300, 70, "Performance overview"),
        block(1, 40, 770, 500, 790, footer.format(1)), block(2, 40, 770, 500, 790, footer.format(2)),
        block(2, 40, 300, 500, 320, "Body of page two"),
        block(1, 40, 10, 500, 30, "A long heading close to the top that is on one page only and so it is kept here",
              doc="e"),
        block(3, 40, 775, 80, 790, "3"),
    ]
    pages = layout.extract_pages(spark.createDataFrame(blocks, schemas.BLOCK))
    got = {(r["document_id"], r["page"]): r["text"] for r in pages.collect()}
    assert got[("d", 1)] == "Performance overview"
    assert got[("d", 2)] == "Body of page two"
    assert got[("d", 3)] == ""
    assert got[("e", 1)].startswith("A long heading")


def test_pages_without_blocks_keep_a_row(spark):
    blocks = spark.createDataFrame([block(1, 40, 100, 90, 120, "x")], schemas.BLOCK)
    page_list = spark.createDataFrame([("d", 1), ("d", 2)], "document_id string, page int")
    got = {r["page"]: r["text"] for r in layout.extract_pages(blocks, page_list).collect()}
    assert got == {1: "x", 2: ""}


def test_repeat_key(spark):
    df = spark.createDataFrame([("Page 12  of 268 ",), ("page 13 of\n9",)], "t string")
    assert {r[0] for r in df.select(ft.repeat_key(F.col("t"))).collect()} == {"page # of #"}


@pytest.mark.parametrize("text,reason", [
    ("   \n ", quality.NEAR_EMPTY), ("Cover", quality.NEAR_EMPTY),
    ("Readable words enough for a page (cid:12) here", quality.GARBAGE),
    ("Readable words " + "�" * 5 + " enough for a page", quality.GARBAGE),
    ("12,345 67,890 11.2 3.4 99,000 1,234 5,678 9,012", None),
    ("(cid:1)", quality.NEAR_EMPTY),
])
def test_quality_flags(spark, text, reason):
    pages = spark.createDataFrame([("d", 1, text)], schemas.PAGE)
    assert [r["reason"] for r in quality.flag_low_quality_pages(pages).collect()] == (
        [reason] if reason else [])


def test_thin_documents(spark):
    rows = [("notice", 1, "Transcript is on our website.")]
    rows += [("report", p, "word " * 200) for p in range(15)]
    thin = quality.flag_thin_documents(spark.createDataFrame(rows, schemas.PAGE))
    assert [r["document_id"] for r in thin.collect()] == ["notice"]


def test_excerpt_and_stem(spark):
    df = spark.createDataFrame([("a  b\nc " * 10,)], "t string")
    assert df.select(ft.excerpt(F.col("t"), 5)).first()[0] == "a b c…"
    words = ["companies", "glasses", "status", "boss", "margins", "does", "ies", "trees"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(ft.stem(F.col("w"))).collect()] == [
        "company", "glasse", "status", "boss", "margin", "doe", "y", "tree"]
