"""Search, entities and routing on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import entities, hybrid, keywords, postings, vectors

DOCS = "chunk_id bigint, content string, symbol string, doc_type string, period string, " \
       "page int, section string, source_url string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    texts = ["Capital expenditure rose.", "Capex plans for refineries and capex.",
             "Net profit and dividends fell", "The dividend policy stands", "Attrition was low",
             "expenditure of capital nature", "Margins, margins and margin guidance", "Nothing here"]
    rows = [(i, text, "TCS" if i % 2 else "INFY", "concall", None if i == 3 else "FY2025",
             i + 1, None, f"u{i}", None if i == 5 else rng.normal(size=6).tolist())
            for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def found(spark, chunks, text):
    asked = ask(spark, text)
    rows = postings.matching_chunks(asked, postings.build_postings(chunks)).collect()
    direct = postings.matching_chunks(asked, postings.postings_for(asked, chunks)).collect()
    assert sorted(rows) == sorted(direct)
    return {r["chunk_id"] for r in rows}


@pytest.mark.parametrize("text,want", [
    ("capital expenditure", {0, 5}),
    ('"capital expenditure"', {0}),
    ("capex OR attrition", {1, 4}),
    ('"capital expenditure" OR capex', {0, 1}),
    ("dividend", {2, 3}),
    ("dividend -profit", {3}),
    ('capital -"capital expenditure"', {5}),
    ("the", set()),
    ("the dividends", {2, 3}),
    ('"expenditure of capital"', {5}),
    ("missing OR", set()),
    ("-capex", set()),
])
def test_query_semantics(spark, chunks, text, want):
    assert found(spark, chunks, text) == want


def test_score_rewards_frequency(spark, chunks):
    asked = ask(spark, "margin OR capex")
    ranked = postings.rank_text(asked, postings.build_postings(chunks), 5).collect()
    scores = {r["chunk_id"]: r["score"] for r in ranked}
    assert scores == {6: pytest.approx(3 / 4 / 2), 1: pytest.approx(2 / 3 / 2)}


def test_stored_and_refreshed_postings(spark, chunks, tmp_path):
    path = str(tmp_path / "p")
    postings.store_postings(postings.build_postings(chunks), path, buckets=8, splits=2)
    asked = ask(spark, '"capital expenditure" OR capex')
    index = postings.stored_postings(spark, path, asked, buckets=8)
    assert {r["chunk_id"] for r in postings.matching_chunks(asked, index).collect()} == {0, 1}
    changed = chunks.filter("chunk_id = 4").withColumn("content", F.lit("More capex"))
    fresh = postings.refresh_postings(postings.build_postings(chunks), changed)
    assert {r["chunk_id"] for r in postings.matching_chunks(asked, fresh).collect()} == {0, 1, 4}


def brute(chunks, questions, k):
    rows = [r for r in chunks.collect() if r["embedding"] is not None]
    out = {}
    for q in questions.collect():
        qv = np.array(q["embedding"], dtype=float)
        scored = []
        for r in rows:
            if any(q[f"filter_{f}"] is not None and q[f"filter_{f}"] != r[f]
                   for f in ("symbol", "doc_type", "period")):
                continue
            v = np.array(r["embedding"], dtype=float)
            scored.append((-round(float(qv @ v / np.linalg.norm(qv) / np.linalg.norm(v)), 9),
                           r["chunk_id"]))
        out[q["query_id"]] = [c for _, c in sorted(scored)[:k]]
    return out


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist(), "capex OR dividend",
             [None, "TCS", None, None][i % 4], [None, None, "concall", None][i % 4],
             [None, None, None, "FY2025"][i % 4]) for i in range(9)]
    return spark.createDataFrame(
        rows, "query_id bigint, embedding array<float>, text string, filter_symbol string, "
              "filter_doc_type string, filter_period string")


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 700}])
def test_vector_ranks_match_brute_force(spark, chunks, questions, limits):
    """One block and several give the same, exact answer."""
    got = {}
    for r in vectors.rank_chunks(questions, chunks, 3, **limits).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == brute(chunks, questions, 3)


@pytest.mark.parametrize("limits", [{}, {"block_bytes": 700}])
def test_each_question_can_have_its_own_k(spark, chunks, questions, limits):
    asked = questions.withColumn("k", (F.col("query_id") % 3 + 1).cast("int"))
    counts = vectors.rank_chunks(asked, chunks, 2, **limits).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in counts} == {i: i % 3 + 1 for i in range(9)}


def test_ties_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)]
    pool = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    ranked = vectors.rank_chunks(asked, pool, 10).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in ranked] == [(1, 1.0), (2, 1.0), (4, 0.0), (3, None)]


def test_probing_all_cells_is_exact(spark, chunks, questions):
    asked = questions.select("query_id", "embedding")
    centres = vectors.fit_cells(chunks, 3)
    celled = vectors.assign_cells(chunks.select("chunk_id", "embedding"), centres)
    approx = vectors.approx_rank_chunks(asked, celled, centres, 4, probes=3)
    exact = vectors.rank_chunks(asked, chunks, 4)
    assert approx.exceptAll(exact).count() == exact.exceptAll(approx).count() == 0
    assert vectors.recall(approx, exact).first()["recall"] == 1.0


def test_codes_first_then_vectors(spark, tmp_path):
    """Stored cells and codes find what the exact search finds; probes are measured."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 16)) * 3
    rows = [(i, (centres[i % 9] + rng.normal(size=16)).astype("float32").tolist()) for i in range(900)]
    rows += [(2000, [0.0] * 16), (2001, None)]
    pool = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(f"q{i}", rows[i * 7][1]) for i in range(12)],
                                  "query_id string, embedding array<float>")
    fitted = vectors.fit_cells(pool)
    assert len(fitted) == 30
    path = str(tmp_path / "cells")
    vectors.store_cells(vectors.assign_cells(pool, fitted), path)
    celled = spark.read.parquet(path)
    assert celled.count() == 901
    probes = vectors.tune_probes(celled, fitted, 5)
    assert 1 <= probes < 15
    exact = vectors.rank_chunks(asked, pool, 5)
    near = vectors.approx_rank_chunks(asked, celled, fitted, 5, probes)
    assert vectors.recall(near, exact).first()["recall"] >= 0.9
    all_cells = vectors.approx_rank_chunks(asked, celled, fitted, 5, 30, oversample=8)
    assert all_cells.exceptAll(exact).count() == exact.exceptAll(all_cells).count() == 0
    plan = near._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "cell" in plan


def test_open_cells_are_searched_too(spark, tmp_path):
    """Vectors without clusters: one probe misses neighbours, the reach of the cells brings them."""
    rows = [(i, v.tolist()) for i, v in enumerate(
        np.random.default_rng(4).normal(size=(600, 8)).astype("float32"))]
    pool = spark.createDataFrame([*rows, (700, [0.0] * 8)], "chunk_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(i, rows[i * 20][1]) for i in range(20)],
                                  "query_id bigint, embedding array<float>")
    fitted, path = vectors.fit_cells(pool), str(tmp_path / "cells")
    vectors.store_cells(vectors.assign_cells(pool, fitted), path)
    celled, exact = spark.read.parquet(path), vectors.rank_chunks(asked, pool, 5)
    one = vectors.approx_rank_chunks(asked, celled, fitted, 5, 1, 8)
    assert vectors.recall(one, exact).first()["recall"] < 0.9
    for stored in (celled, celled.drop("code")):
        whole = vectors.approx_rank_chunks(asked, stored, fitted, 5, 1, 8,
                                           vectors.cell_reach(stored, fitted))
        assert whole.exceptAll(exact).count() == exact.exceptAll(whole).count() == 0


def test_winners_prune_the_chunk_store(spark, chunks, questions, tmp_path):
    path = str(tmp_path / "chunks")
    vectors.store_chunks(chunks.withColumns({"section": F.lit(None).cast("string"),
                                             "page": F.lit(1), "source_url": F.lit("u")}), path)
    pool = spark.read.parquet(path)
    found = vectors.vector_search_filtered(questions, pool, 3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == brute(chunks, questions, 3)
    assert "dynamicpruning" in found._jdf.queryExecution().toString()


def test_fusion_weights(spark, chunks, questions):
    asked = questions.filter("filter_symbol IS NULL")
    only_vector = hybrid.hybrid_search(asked, chunks, k=5, weight=1.0).filter("vector_rank <= 5")
    assert only_vector.filter("rank <> vector_rank").count() == 0
    only_text = hybrid.hybrid_search(asked, chunks, k=2, weight=0.0)
    assert only_text.filter("rank <> text_rank").count() == 0
    both = hybrid.hybrid_search(asked, chunks, k=8).filter("text_rank IS NULL").first()
    assert both["score"] == pytest.approx(0.5 / (60 + both["vector_rank"]))


def test_gate():
    assert hybrid.GATE_THRESHOLD == 0.60


def test_gate_rows(spark):
    df = spark.createDataFrame([(1, 0.6, 3), (2, 0.59, 3), (3, 0.9, 0)],
                               "query_id int, max_score double, n_sources int")
    rows = hybrid.confidence_gate(df).orderBy("query_id").collect()
    assert [(r["refused"], r["shown_sources"]) for r in rows] == [(False, 3), (True, 0), (True, 0)]


@pytest.mark.parametrize("question,drop,want", [
    ("What are Reliance's capital expenditure plans?", ["reliance"],
     '"capital expenditure" OR capex OR capital OR expenditure OR plans'),
    ("What did TCS say about NIM?", ["tcs"], 'nim OR "net interest margin"'),
    ("What is it?", [], ""),
    ("Deal wins and TCV", None,
     '"deal wins" OR tcv OR "large deals" OR deal OR wins OR "total contract value"'),
])
def test_keyword_shaping(spark, question, drop, want):
    df = spark.createDataFrame([(question, drop)], "q string, d array<string>")
    assert df.select(keywords.shape_keyword_query(F.col("q"), F.col("d"))).first()[0] == want


COMPANIES = [("TCS", "Tata Consultancy Services Limited"), ("TMCV", "Tata Motors Limited"),
             ("TMPV", "Tata Motors Passenger Vehicles Limited"), ("INFY", "Infosys Limited"),
             ("HDFCBANK", "HDFC Bank Limited"), ("RELIANCE", "Reliance Industries Limited")]


@pytest.fixture(scope="module")
def companies(spark):
    return spark.createDataFrame(COMPANIES, "symbol string, name string")


ENTITY_SCORES = [
    ("tcs", [("TCS", 1000)]), ("hdfc", [("HDFCBANK", 896)]), ("infosys limited", [("INFY", 850)]),
    ("motors", [("TMCV", 820), ("TMPV", 820)]), ("relian", [("RELIANCE", 898)]),
    ("infosis", [("INFY", 129)]), ("dfcb", [("HDFCBANK", 599)]), ("rlnc", [("RELIANCE", 120)]),
    ("zzzzzz", []),
]


@pytest.fixture(scope="module")
def entity_scores(spark, companies):
    asked = spark.createDataFrame([(q,) for q, _ in ENTITY_SCORES], "query string")
    return entities.score_entities(asked, companies, 5).orderBy("query", "rank").collect()


@pytest.mark.parametrize("query,want", ENTITY_SCORES)
def test_entity_scores(entity_scores, query, want):
    rows = [(r["symbol"], r["score"]) for r in entity_scores if r["query"] == query]
    assert rows[:len(want) or None] == want


@pytest.mark.parametrize("question,kind,reason,symbols", [
    ("What did Infosys say about attrition?", "scope", None, ["INFY"]),
    ("Compare Infosys and TCS", "choose", "multiple", ["TCS", "INFY"]),
    ("What did Tata say about demand?", "choose", "ambiguous", ["TCS", "TMCV", "TMPV"]),
    ("What did Tata Motors announce?", "choose", "ambiguous", ["TMCV", "TMPV"]),
    ("How is the bank outlook?", "none", None, []),
    ("Infosys against motors", "choose", "multiple", ["INFY", "TMCV", "TMPV"]),
])
def test_routing(spark, companies, question, kind, reason, symbols):
    asked = spark.createDataFrame([(1, question)], "question_id bigint, question string")
    decisions, choices = entities.route_questions(asked, companies)
    got = decisions.first()
    assert (got["kind"], got["reason"]) == (kind, reason)
    assert [r["symbol"] for r in choices.orderBy("choice_rank").collect()] == symbols


def test_stored_index_reads_few_blocks_and_loses_nothing(spark, tmp_path):
    """Blocks whose bound is under the k-th score are left out; ranks are those of all."""
    rng = random.Random(11)
    words = ["capex", "dividend", "margin", "order", "plant", "debt"]
    rows = []
    for i in range(400):
        # a quarter of the chunks is long and repeats its words
        n = rng.randint(60, 120) if i % 4 == 0 else rng.randint(1, 6)
        rows.append((i, " ".join(rng.choice(words) for _ in range(n)) if i % 50 else None,
                     f"S{i % 3}", "concall", "FY2025" if i % 2 else None))
    chunks = spark.createDataFrame(
        rows, "chunk_id bigint, content string, symbol string, doc_type string, period string")
    path = str(tmp_path / "index")
    postings.store_index(chunks, path, buckets=4, blocks=4)
    index = postings.StoredIndex(spark, path, 4)
    asked = spark.createDataFrame(
        [(1, "capex", None), (2, "capex OR dividend", "S1"), (3, "margin -debt", None),
         (4, '"order plant" OR debt', "S2"), (5, "nothing here", None), (6, "the", None)],
        "query_id bigint, text string, filter_symbol string")
    full = postings.rank_text(asked, postings.build_postings(chunks, postings.CARRIED), 5)
    got = postings.rank_stored(asked, index, 5, small=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    assert sorted(map(tuple, postings.rank_stored(asked, index, 5).collect())) == \
        sorted(map(tuple, full.collect()))
    wanted = postings.query_terms(asked)
    uppers = postings.block_bounds(wanted, index, postings._buckets(wanted, index)).filter("query_id = 1")
    reached = full.filter("query_id = 1 AND rank = 5").first()["score"]
    assert uppers.filter(F.col("upper") + 1e-8 >= reached).count() < uppers.count() == 4
    none = postings.rank_stored(asked.limit(0), index, 5)
    assert none.count() == 0


def test_text_search_in_sql_joins_its_terms(spark, chunks, tmp_path):
    """The words of the search text are worked out once and joined, not tested row by row."""
    from foliospark.plans import sql_functions

    path = str(tmp_path / "index")
    postings.store_index(chunks, path, buckets=4, blocks=2)
    keyed = chunks.withColumn("id", F.col("chunk_id").cast("string"))
    sql_functions.register(
        spark, keyed.select("id", F.col("id").alias("document_id"), "content", "page", "embedding"),
        keyed.select("id", "symbol", "doc_type", "period", "source_url"),
        postings.StoredIndex(spark, path, 4))
    found = spark.sql("SELECT * FROM search_chunks('dividends margins', 5, true)")
    assert [r["id"] for r in found.collect()] == ["6", "2", "3"]
    assert "Join Inner" in found._jdf.queryExecution().optimizedPlan().toString()
    both = spark.sql("SELECT id FROM search_chunks('net dividend', filter_symbol => 'INFY')")
    assert [r["id"] for r in both.collect()] == ["2"]
    assert spark.sql("SELECT * FROM search_chunks('the of', 5, true)").count() == 0


def test_postings_are_grouped_within_the_row(spark, chunks):
    """No token is shuffled; rows that repeat an id are still put together; nulls give nothing."""
    built = postings.build_postings(chunks, ("symbol",))
    assert "Exchange" not in built._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(1, "the cats, a cat"), (1, "dogs"), (2, None), (3, "of"), (4, "Cats cat x")],
                                 "chunk_id bigint, content string")
    for table in (rows, rows.filter("content <> 'dogs' OR content IS NULL")):
        whole = postings._group(postings.token_rows(table))
        made = postings.build_postings(table)
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, whole.collect()))


def test_tasks_grow_with_the_text(spark, chunks, monkeypatch, tmp_path):
    monkeypatch.setattr(postings, "PART_CHARS", 2)
    parts = postings.task_parts(chunks)
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ask(spark, '"capital expenditure" OR capex')
    made = postings.postings_for(asked, chunks)
    found = postings.matching_chunks(asked, made, parts=parts)
    assert f"{parts}" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["chunk_id"] for r in found.collect()} == {0, 1}
    postings.store_postings(made, str(tmp_path / "p"), 2, parts=parts)
    assert spark.read.parquet(str(tmp_path / "p")).count() == made.count()


def test_stored_index_deals_texts_and_not_their_postings(spark, tmp_path):
    """All postings of a chunk are written by the task that got its text."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    chunks = spark.createDataFrame(
        [(i, " ".join(rng.choices(words, k=rng.randint(1, 80))), "S", "concall", "FY2025")
         for i in range(80)], "chunk_id bigint, content string, symbol string, doc_type string, "
                              "period string").repartition(4)
    path = str(tmp_path / "dealt")
    postings.store_index(chunks, path, buckets=4, blocks=3)
    index = postings.StoredIndex(spark, path, 4)
    task = F.regexp_extract(F.input_file_name(), r"part-(\d+)-", 1)
    tasks = index.postings.select("chunk_id", task.alias("task")).groupBy("chunk_id").agg(
        F.countDistinct("task").alias("n"))
    assert [tuple(r) for r in tasks.groupBy("n").count().collect()] == [(1, 80)]
    built = postings.build_postings(chunks).select("chunk_id", "term", "tf", "positions")
    stored = index.postings.select(*built.columns)
    assert stored.exceptAll(built).isEmpty() and built.exceptAll(stored).isEmpty()
