"""Languages, language model, rules, classifier and page texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from foliospark.llm import cotrain, html_text, langmix, lblm, rules
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def language_rows(n=240):
    rng = random.Random(3)
    syllables = {"en": ["th", "er", "ing", "and"], "fr": ["eau", "é", "oi", "que"],
                 "de": ["sch", "ü", "ung", "ein"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20))
        rows.append((i, text, lang, "s", len(text)))
    return rows, syllables


def test_languages_of_held_out_texts(spark):
    rows, syllables = language_rows()
    rng = random.Random(9)
    mixed = " ".join("".join(rng.choice(syllables[g]) for _ in range(3))
                     for g in ["en"] * 60 + ["fr"] * 40)
    extra = [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "12 !?", "fr", "s", 0),
             (1003, mixed, None, "s", 0), (None, "thering", "en", "s", 0), (1004, "a", None, "s", 0),
             (1006, " I\n", "fr", "s", 0), (5, "und " * 3, None, None, None)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    got = {r.doc_id: r for r in langmix.identify(docs).collect()}
    for i, _, lang, *_ in rows:
        if i != 5:
            assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
            assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert set(got[1003].mixture) == {"en", "fr"} and 0.5 < got[1003].mixture["en"] < 0.75
    for i in (1004, 1006):                            # one letter: the most frequent language
        assert got[i].lang_pred in syllables and 0 < got[i].score <= 1
    assert got[None].held_out is False
    nothing = langmix.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    assert langmix.identify(docs.limit(0)).collect() == []


def test_language_model_base_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(lblm, "COMMON", 20)           # most words go through the join
    rows, _ = language_rows(80)
    rows += [(900, None, None, None, None), (901, " ", None, None, None),
             (902, "unseen words only", None, None, None), (902, "the the", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = lblm.score_documents(docs).collect()
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    tokens = lambda t: (t or "").lower().split() + [None]
    counts = Counter(x for i, t, *_ in rows if learn(i) for x in tokens(t))
    total, types = sum(counts.values()), len(counts)
    want = sorted((i, not learn(i), len(tokens(t)), sum(x in counts for x in tokens(t)), total,
                   round(sum(math.log10((counts[x] + .5) / (total + .5 * (types + 1)))
                             for x in tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    none = lblm.score(docs, F.lit(False)).collect()
    assert {r.n_known for r in none} == {0} and {r.train_tokens for r in none} == {0}
    assert lblm.score_documents(docs.limit(0)).collect() == []


def test_class_probabilities_add_up():
    rng = np.random.default_rng(1)
    model = lblm.Model.start(np.full(lblm.CLASSES, 1 / lblm.CLASSES))
    z = model.normalisers()
    for one, two in rng.integers(0, lblm.CLASSES + 1, (5, 2)):
        n = np.arange(lblm.CLASSES)
        p = np.exp(model.log_prob(np.full(len(n), one), np.full(len(n), two), n, z))
        assert abs(p.sum() - 1) < 1e-4


def test_training_learns_which_class_follows():
    rng = np.random.default_rng(2)
    target = np.resize([3, 7, 9], 60_000)
    target[rng.random(len(target)) < 0.1] = 5
    one, two = np.roll(target, 1), np.roll(target, 2)
    frequency = (np.bincount(target, minlength=lblm.CLASSES) + 0.5)
    frequency /= frequency.sum()
    model = lblm.Model.start(frequency)
    trainer = lblm.Trainer(model, frequency, 1)
    for at in range(2, len(target), 512):
        trainer.step(one[at:at + 512], two[at:at + 512], target[at:at + 512])
    gained = model.log_prob(one, two, target, model.normalisers()).mean() \
        - np.log(frequency[target]).mean()
    assert gained > 0.3


def test_largest_count_is_the_exact_tail(spark):
    cases = [(n, a, d) for n in (1, 10, 60, 400, 3000) for a in (0.01, 0.2) for d in (0.05, 0.5)]
    for n, a, d in cases:
        got = spark.range(1).select(rules.largest_count(
            F.lit(n).cast("bigint"), a, F.lit(d)).alias("k")).first().k
        tail, k = 0.0, -1
        for j in range(int(n * a) + 1):
            tail += math.comb(n, j) * a ** j * (1 - a) ** (n - j) if n < 1000 else math.exp(
                math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1)
                + j * math.log(a) + (n - j) * math.log(1 - a))
            if tail <= d and j < n:
                k = j
        assert got == k, (n, a, d)


def rule_rows():
    rng = random.Random(4)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1600):
        text = " ".join(rng.choice(words) for _ in range(60))
        if i % 100 == 0:
            text = text.replace(" ", " %%% ")
        rows.append((i, text, "en" if i < 1500 else None, "s", 0))
        labels.append((i, 0 if i % 100 == 0 else 1, 0))
    rows += [(5000, None, "en", None, None), (5001, "", "fr", None, None),
             (5002, "a b c " * 40, "en", None, None), (5003, "x\nx\n\nx \n", "en", None, None),
             (None, "few", None, None, None), (1, "short", "en", None, None)]
    return rows, labels + [(1, None, None), (7, 1, 0), (9999, 1, 0), (None, 1, 1)]


def plain_counts(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_rules(spark):
    rows, labels = rule_rows()
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = rules.verdicts(docs, marks).collect()
    want = sorted(((i, *plain_counts(t)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    english = {r.doc_id: r.kept for r in got if r.doc_id is not None and 1 < r.doc_id < 1500}
    assert not any(english[i] for i in range(100, 1500, 100))
    lost = sum(not k for i, k in english.items() if i % 100)
    assert lost <= rules.ALPHA * 1500
    assert all(r.kept for r in got if r.doc_id in range(1500, 1600))    # too few labels
    bare = rules.verdicts(docs, marks.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in bare)
    assert rules.verdicts(docs.limit(0), marks).collect() == []


def test_rules_match_their_sql(spark, sf_dir):
    from compare import compare, connect
    from foliospark.llm import catalog
    name = "op5_risk_controlled_rules"
    assert compare(spark, connect(sf_dir), sf_dir, catalog.QUERIES[name],
                   catalog.ORACLES[name]) is None


def quality_rows():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice(words) + ("***" if bad and i % 8 == 0 else "") for _ in range(40))
        if bad and i % 8 == 4:
            text += " idiot clown"
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None]), len(text)))
        if i < 400:
            labels.append((i, 0 if i % 8 == 0 else 1, 1 if i % 8 == 4 else 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s1", 0), (None, "w1 w2", "en", "s", 5)]
    return rows, labels + [(3, None, None), (None, 0, 1), (7777, 0, 0), (5, 1, None)]


def test_classifier_tells_bad_from_good(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], DOCS + ", score double")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    out = cotrain.classify(docs, marks)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    new = [i for i in range(400, 600)]
    right = np.mean([got[i].kept == (i % 4 != 0) for i in new])
    assert right > 0.95
    for empty in (marks.limit(0), marks.filter("quality = 1 AND toxic = 0")):
        assert {(r.score, r.kept) for r in cotrain.classify(docs, empty).collect()} == {(1.0, True)}
    assert cotrain.classify(docs.limit(0), marks).collect() == []


PAGES = {
    "plain": ("<html><head><title>No</title></head><body><nav><a>Home</a> <a>News</a></nav>"
              "<article><h1>A  title</h1><p>First &amp; long text, with points. And more, yes.</p>"
              "<p>Short.<br>Line</p></article><footer>Made by us.</footer></body></html>",
              "A title First & long text, with points. And more, yes. Short. Line"),
    "parts": ("<body><div class='cookie-notice'>We use cookies, a lot.</div><div id=content>"
              "<h2>Head</h2><p>Text of the page, which is long enough. It goes on, and on.</p>"
              "<form><input value='>'>Search here, please</form><p>Next one, also long, and with "
              "marks; yes.</p><ul><li>one<li>two</ul><div class=comments><p>Great read, thanks, I "
              "liked it. A lot!</p></div></div><aside>Related, stories.</aside>",
              "Head Text of the page, which is long enough. It goes on, and on. "
              "Next one, also long, and with marks; yes. one two"),
    "script": ("<script>var a='</p><p>x';</script><style>p{}</style><!-- <p>no</p> --><p>Yes, this "
               "text is here. Only this.", "Yes, this text is here. Only this."),
    "broken": ("<article><p>Unclosed <b>bold text, and more. Yes.<p>Second < third & so on.</p>"
               "<footer>x", "Unclosed bold text, and more. Yes. Second < third & so on."),
    "empty": ("", ""), "null": (None, ""), "no text": ("<p></p><div>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_article_of_a_page(name):
    html, want = PAGES[name]
    assert html_text.main_text(html) == want


def test_pages_as_a_table(spark):
    rows = [(i, f"u{i}", h, 1) for i, (h, _) in enumerate(PAGES.values())] + [(0, None, None, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    want = [(i, t, len(t)) for i, (_, t) in enumerate(PAGES.values())] + [(0, "", 0)]
    assert got == sorted(want)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_a_very_long_page():
    html = "<article>" + "<div><p>Some text, here.</p>" * 3000 + "</article>"
    assert len(html_text.main_text(html)) == 3000 * 17 - 1


STORY = "<h1>Title</h1><p>A long story, with points. It goes on, and on.</p><p>More of it; yes.</p>"
TOLD = "Title A long story, with points. It goes on, and on. More of it; yes."


@pytest.mark.parametrize("html", [
    f"<div class='layout-right-sidebar'>{STORY}</div><footer>Us.</footer>",
    f"<div class='page-with-sidebar'><article>{STORY}</article></div>",
    f"<div id='search-results'><div class='content widget-area'><main>{STORY}</main></div></div>",
    f"<article class='share-price'>{STORY}<div class='share'>Share this, now.</div></article>",
    f"<div class='page-with-sidebar'><div>{STORY.replace('h1', 'h2')}</div><div class='sidebar'>"
    "Other, short.</div></div>",
    f"<article>{STORY}</article><div class='comments'><article class='comment'>Great, thanks.</article>"
    + "<p>I liked it, a lot. And you, too?</p>" * 9 + "</div>",
    f"<div class='post'>{STORY}</div><div class='related'><article>Another, one.</article></div>"])
def test_names_alone_do_not_drop_the_article(html):
    assert html_text.main_text(f"<html><body>{html}</body></html>") == TOLD


def test_sample_brings_no_ones_to_the_driver():
    """Of a text only its numbers travel with values; words count as 1 and rare ones stay out."""
    import pyarrow as pa
    from foliospark.llm import cotrain

    texts = [f"the cat number{i} sat" for i in range(8)]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(8), pa.int64()), "text": texts, "lang": ["en"] * 8,
        "source": ["s"] * 8, "n_chars": pa.array([9] * 8, pa.int64()),
        "good": pa.array([1, 0] * 4, pa.int32())})
    rows = pa.Table.from_batches(list(cotrain._sample_features([batch])))
    words = rows.filter(pa.compute.equal(rows.column("view"), 0))
    assert {len(v) for v in words.column("value").to_pylist()} == {cotrain.NUMBERS}
    made = cotrain._sample(words, 0)
    whole = cotrain.text_features(next(iter(cotrain.pieces(batch)))[1])
    often = np.bincount(whole.index, minlength=whole.size) >= cotrain.LEAST_DOCS
    often[cotrain.WORD_BUCKETS:] = True
    keep = often[whole.index]
    assert 0 < keep.sum() < len(keep)
    assert (made.index == whole.index[keep]).all() and (made.value == whole.value[keep]).all()
    assert (made.row == whole.row[keep]).all()
