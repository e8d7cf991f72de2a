"""The pipeline's stages against plain versions, and its parts as registered."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from foliospark.llm import catalog
from test_jaccard import brute
from test_repeats import brute_hits, words
from test_tokens import ids_of

LABELS = [(i, 0 if i % 8 == 0 else 1, 1 if i % 8 == 4 else 0) for i in range(200)]


def made_documents():
    rng = random.Random(6)
    vocabulary = [f"word{i}é" for i in range(150)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    item = " ".join(rng.choice(vocabulary) for _ in range(20))
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        text = " ".join(rng.choice(vocabulary) for _ in range(60))
        if bad:
            text = text.replace(" ", "*** ") if i % 8 == 0 else text + " idiot clown moron"
        elif i % 10 == 1:
            text += " " + passage
        elif i % 10 == 3:
            text += " " + item
        elif i % 10 == 7 and len(rows) > 3:
            text = rows[-2][1] + " more"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (None, "no id", None, "s", 5)]
    return rows, [(1, item), (2, None), (None, "short one")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows, items = made_documents()

    def write(name, columns, kinds, values):
        pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*values), kinds)],
                                names=columns), path / f"{name}.parquet")

    n, s = pa.int64(), pa.string()
    write("documents", ["doc_id", "text", "lang", "source", "n_chars"], [n, s, s, s, n], rows)
    write("labels", ["doc_id", "quality", "toxic"], [n, pa.int32(), pa.int32()], LABELS)
    write("benchmark", ["item_id", "text"], [n, s], items)
    return str(path)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark, folder):
    rows, items = made_documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality"](spark, docs, folder)
    kept = rows_of(good)
    clean = {r[0] for r in rows if r[0] is not None and r[0] < 300 and r[0] % 4}
    assert clean <= {i for i, _ in kept} and not {i for i, _ in kept} & set(range(0, 300, 4))

    single = stages["near_duplicates"](spark, good.cache(), folder)
    found = brute(kept, 5, 80)
    stay = {d for d, n, c in found if d is not None and d == c}
    assert {i for i, _ in rows_of(single)} - {None} == stay

    once = stages["repeated_passages"](spark, single.cache(), folder)
    before, after = rows_of(single), dict(rows_of(once))
    first = {}
    for doc_id, text in sorted((r for r in before if r[0] is not None), key=lambda r: r[0]):
        raw, keep = (text or "").encode(), set()
        for i in range(len(raw) - 49):
            if first.setdefault(raw[i:i + 50], doc_id) < doc_id:
                keep.update(range(i, i + 50))
        left = bytes(b for i, b in enumerate(raw) if i not in keep).decode("utf-8", "ignore")
        # Characters of which a repeat holds a part stay whole.
        assert (after[doc_id] or "").replace("é", "").replace(" ", "") == \
            left.replace("é", "").replace(" ", "")
    assert all(r.n_chars == (None if r.text is None else len(r.text)) or r.doc_id in (400, None)
               for r in once.collect())

    safe = stages["decontamination"](spark, once.cache(), folder)
    bad = {r[0] for r in brute_hits(rows_of(once), items) if r[5]}
    assert bad and {i for i, _ in rows_of(safe)} == {i for i in after if i not in bad}
    for part in (good, single, once, safe):
        assert tuple(part.columns) == corpus_pipeline.COLUMNS

    packed = stages["packing"](spark, safe.cache(), folder).collect()
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    assert length == {i: len(ids_of(t)) for i, t in rows_of(safe)}
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in whole) == sorted(
        (r.doc_id or -1, r.start, r.length, r.ids_crc32) for r in packed)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        docs = out if "text" in out.columns else docs


def test_registered_queries_give_their_columns(spark, sf_dir):
    names = {n.split("_")[0] for n in catalog.queries()}
    assert names == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, columns in {
            "op2": ["doc_id", "held_out", "lang_pred", "score"],
            "op3": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            "op8": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            "op9": ["doc_id", "start", "n_tokens", "ids_crc32"]}.items():
        run = next(q for n, q in catalog.queries().items() if n.startswith(f"{name}_"))
        out = run(spark, sf_dir)
        assert out.columns == columns and out.count() == docs.count()


def test_words_of_the_pattern():
    assert words("A-b é9 ") == ["a", "b", "é9"]
