"""Registered queries: vector, keyword and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.catalog.inputs import Tables, query
from foliospark.functions.text import STOP_WORDS
from foliospark.operators import hybrid, keywords, postings, vectors
from foliospark.session import shared_folder


def words_sql(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def stem_sql(t: str) -> str:
    return f"""CASE WHEN NOT ends_with({t}, 's') THEN {t}
      WHEN ends_with({t}, 'ies') AND NOT ends_with({t}, 'eies') AND NOT ends_with({t}, 'aies')
        THEN left({t}, length({t}) - 3) || 'y'
      WHEN ends_with({t}, 'es') AND NOT ends_with({t}, 'aes') AND NOT ends_with({t}, 'ees')
        AND NOT ends_with({t}, 'oes') THEN left({t}, length({t}) - 1)
      WHEN NOT ends_with({t}, 'us') AND NOT ends_with({t}, 'ss') THEN left({t}, length({t}) - 1)
      ELSE {t} END"""


LABEL_SQL = """symbol || ' ' || doc_type || coalesce(' (' || period || ')', '')
  || ' — ' || source_url"""

# Cosine of every question with every visible vector, ranked.
VECTOR_CTES = """
  sims AS (
    SELECT q.query_id, c.chunk_id,
      round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9)
        AS score
    FROM {questions} q JOIN {chunks} c ON c.embedding IS NOT NULL AND q.embedding IS NOT NULL
      AND (q.filter_symbol IS NULL OR q.filter_symbol = c.symbol)
      AND (q.filter_doc_type IS NULL OR q.filter_doc_type = c.doc_type)
      AND (q.filter_period IS NULL OR q.filter_period = c.period)),
  vector_ranks AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM sims)"""

TOKEN_CTES = f"""
  words AS (
    SELECT chunk_id, unnest(w) AS raw, generate_subscripts(w, 1) AS pos FROM (
      SELECT chunk_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS w
      FROM chunks)),
  tokens AS (
    SELECT chunk_id, pos, {stem_sql('raw')} AS term FROM words
    WHERE raw NOT IN ({words_sql(STOP_WORDS)}))"""


def text_ctes(source: str) -> str:
    """Keyword matches of ``source`` (query_id, text): (query_id, chunk_id, score)."""
    return TOKEN_CTES + f""",
  units AS (
    SELECT query_id, u, unit,
      sum(CASE WHEN lower(u) = 'or' THEN 1 ELSE 0 END)
        OVER (PARTITION BY query_id ORDER BY unit) AS alt
    FROM (SELECT query_id, unnest(us) AS u, generate_subscripts(us, 1) AS unit
          FROM (SELECT query_id, regexp_extract_all(text, '-?"[^"]*"|\\S+') AS us
                FROM {source}))),
  unit_words AS (
    SELECT query_id, alt, unit, regexp_matches(u, '^-["\\p{{L}}\\p{{N}}]') AS negated,
      unnest(w) AS raw, generate_subscripts(w, 1) AS off
    FROM (SELECT *, regexp_extract_all(lower(u), '[\\p{{L}}\\p{{N}}]+') AS w FROM units
          WHERE lower(u) <> 'or')),
  wanted AS (
    SELECT query_id, alt, unit, negated, off, {stem_sql('raw')} AS term FROM unit_words
    WHERE raw NOT IN ({words_sql(STOP_WORDS)})),
  unit_sizes AS (SELECT query_id, unit, count(*) AS unit_terms FROM wanted GROUP BY ALL),
  heads AS (
    SELECT query_id, alt, count(DISTINCT unit) AS alt_units FROM wanted WHERE NOT negated
    GROUP BY ALL),
  unit_hits AS (
    SELECT DISTINCT query_id, alt, unit, negated, chunk_id FROM (
      SELECT w.query_id, w.alt, w.unit, w.negated, t.chunk_id, t.pos - w.off AS start_pos, count(*) AS n
      FROM wanted w JOIN tokens t USING (term) GROUP BY ALL)
    JOIN unit_sizes USING (query_id, unit) WHERE n = unit_terms),
  matched AS (
    SELECT DISTINCT query_id, chunk_id FROM (
      SELECT query_id, alt, chunk_id, count(*) FILTER (NOT negated) AS met,
        count(*) FILTER (negated) AS barred
      FROM unit_hits GROUP BY ALL)
    JOIN heads USING (query_id, alt) WHERE met = alt_units AND barred = 0),
  query_terms AS (
    SELECT DISTINCT query_id, term FROM wanted JOIN heads USING (query_id, alt) WHERE NOT negated),
  tf AS (SELECT chunk_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
  text_scores AS (
    SELECT m.query_id, m.chunk_id,
      round(sum(tf.tf / (tf.tf + 1)) / any_value(n.n_terms), 9) AS score
    FROM matched m JOIN query_terms q USING (query_id)
    JOIN tf ON tf.chunk_id = m.chunk_id AND tf.term = q.term
    JOIN (SELECT query_id, count(*) AS n_terms FROM query_terms GROUP BY ALL) n
      ON n.query_id = m.query_id
    GROUP BY m.query_id, m.chunk_id)"""


@query("vector_search", f"""
WITH {VECTOR_CTES.replace("AND (q.filter_symbol IS NULL OR q.filter_symbol = c.symbol)", "")
      .replace("AND (q.filter_doc_type IS NULL OR q.filter_doc_type = c.doc_type)", "")
      .replace("AND (q.filter_period IS NULL OR q.filter_period = c.period)", "")}
SELECT query_id, rank, chunk_id, {LABEL_SQL} AS source, symbol, round(score, 6) AS similarity,
  left(content, 200) AS content_preview
FROM vector_ranks JOIN {{chunks}} c USING (chunk_id) WHERE rank <= 8""")
def _vector_search(t: Tables):
    q = t("questions").select("query_id", "embedding")
    return vectors.vector_search(q, t("chunks"), 8).select(
        "query_id", "rank", "chunk_id", "source", "symbol",
        F.round("similarity", 6).alias("similarity"),
        F.left("content", F.lit(200)).alias("content_preview"))


@query("vector_search_filtered", f"""
WITH {VECTOR_CTES}
SELECT query_id, rank, chunk_id, content, symbol, doc_type, period, CAST(page AS BIGINT) AS page,
  source_url, round(score, 6) AS score
FROM vector_ranks JOIN {{chunks}} c USING (chunk_id) WHERE rank <= 10""")
def _vector_search_filtered(t: Tables):
    found = vectors.vector_search_filtered(t("questions"), t("chunks"), 10)
    return found.withColumn("score", F.round("score", 6))


@query("approx_vector_search", """
SELECT query_id, CAST(10 AS BIGINT) AS exact_neighbours, true AS found_nine, true AS few_vectors
FROM {questions} WHERE embedding IS NOT NULL""")
def _approx_vector_search(t: Tables):
    """Approximate search over stored cells and codes against the exact one: whether each
    question gets nine of its ten nearest chunks from the vectors of a quarter of all."""
    k, oversample = 10, 4
    chunks = t("chunks").select("chunk_id", "embedding").filter("embedding IS NOT NULL")
    questions = t("questions").select("query_id", "embedding")
    centres, path = vectors.fit_cells(chunks), shared_folder(t.spark, "cells")
    vectors.store_cells(vectors.assign_cells(chunks, centres), path)
    celled = t.spark.read.parquet(path)
    probes = vectors.tune_probes(celled, centres, k, 0.99)
    approx = vectors.approx_rank_chunks(questions, celled, centres, k, probes, oversample,
                                        vectors.cell_reach(celled, centres))
    exact = vectors.rank_chunks(questions, chunks, k)
    found = approx.select("query_id", "chunk_id", F.lit(1).alias("found"))
    # Vectors that a question was scored with: its survivors, at most.
    few = k * oversample * 4 <= celled.count()
    return (
        exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id")
        .agg(F.count("*").alias("exact_neighbours"), (F.count("found") >= 9).alias("found_nine"))
        .withColumn("few_vectors", F.lit(few))
    )


@query("build_postings", f"""
WITH c AS (SELECT * FROM {{chunks}}), {TOKEN_CTES}
SELECT chunk_id, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos,
  CAST(sum(pos) AS BIGINT) AS pos_sum
FROM tokens GROUP BY ALL""")
def _build_postings(t: Tables):
    chunks = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    built = postings.build_postings(chunks)
    return built.select(
        "chunk_id", "term", "tf", F.get("positions", F.lit(0)).alias("first_pos"),
        F.get("positions", F.col("tf") - 1).alias("last_pos"),
        F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p).alias("pos_sum"))


@query("text_search", f"""
WITH c AS (SELECT * FROM {{chunks}}), s AS (SELECT * FROM {{search_texts}}),
{text_ctes('s')}
SELECT query_id, rank, chunk_id, {LABEL_SQL} AS source, symbol, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM text_scores) JOIN chunks USING (chunk_id) WHERE rank <= 8""")
def _text_search(t: Tables):
    found = postings.text_search(t("search_texts"), t("chunks"), k=8)
    return found.select("query_id", "rank", "chunk_id", "source", "symbol",
                        F.round("score", 6).alias("score"))


@query("stored_text_search", f"""
WITH c AS (SELECT * FROM {{chunks}}), s AS (SELECT * FROM {{search_texts}}),
{text_ctes('s')}
SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM text_scores) WHERE rank <= 8""")
def _stored_text_search(t: Tables):
    """The same search over a stored postings table, reading only the buckets it needs."""
    asked, path = t("search_texts"), shared_folder(t.spark, "postings")
    postings.store_postings(postings.build_postings(t("chunks")), path, buckets=32,
                            parts=postings.task_parts(t("chunks")))
    index = postings.stored_postings(t.spark, path, asked, buckets=32)
    found = postings.text_search(asked, t("chunks"), index, 8)
    return found.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def _stored(t: Tables) -> tuple[DataFrame, postings.StoredIndex]:
    """The chunk table and its text index as a search finds them stored."""
    chunks_path, index_path = shared_folder(t.spark, "chunks"), shared_folder(t.spark, "index")
    vectors.store_chunks(t("chunks"), chunks_path)
    chunks = t.spark.read.parquet(chunks_path)
    postings.store_index(chunks, index_path, buckets=8, blocks=4)
    return chunks, postings.StoredIndex(t.spark, index_path, buckets=8)


@query("indexed_text_search", f"""
WITH c AS (SELECT * FROM {{chunks}}), s AS (SELECT * FROM {{search_texts}}),
{text_ctes('s')}
SELECT query_id, rank, chunk_id, {LABEL_SQL} AS source, symbol, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM text_scores) JOIN chunks USING (chunk_id) WHERE rank <= 8""")
def _indexed_text_search(t: Tables):
    """The keyword search from stored chunks and the stored index with its bounds."""
    chunks, index = _stored(t)
    found = postings.text_search(t("search_texts"), chunks, k=8, index=index)
    return found.select("query_id", "rank", "chunk_id", "source", "symbol",
                        F.round("score", 6).alias("score"))


@query("query_semantics", f"""
WITH c AS (SELECT * FROM {{chunks}}), s AS (SELECT * FROM {{search_texts}}),
{text_ctes('s')}
SELECT query_id, chunk_id, round(score, 6) AS score FROM text_scores""")
def _query_semantics(t: Tables):
    """Every match of plain, OR, phrase and excluding searches, unranked."""
    asked, chunks = t("search_texts"), t("chunks")
    found = postings.matching_chunks(asked, postings.postings_for(asked, chunks),
                                     parts=postings.task_parts(chunks))
    return found.withColumn("score", F.round("score", 6))


HYBRID_CTES = f"""
  {VECTOR_CTES}, s AS (SELECT query_id, text FROM {{asked}}),
  {text_ctes('s')},
  visible AS (
    SELECT t.* FROM text_scores t JOIN {{questions}} q USING (query_id) JOIN chunks c USING (chunk_id)
    WHERE (q.filter_symbol IS NULL OR q.filter_symbol = c.symbol)
      AND (q.filter_doc_type IS NULL OR q.filter_doc_type = c.doc_type)
      AND (q.filter_period IS NULL OR q.filter_period = c.period)),
  text_ranks AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM visible),
  fused AS (
    SELECT query_id, chunk_id,
      round(5e-1 * coalesce(1e0 / (60 + v.rank), 0) + 5e-1 * coalesce(1e0 / (60 + t.rank), 0), 12)
        AS score,
      v.rank AS vector_rank, t.rank AS text_rank
    FROM (SELECT * FROM vector_ranks WHERE rank <= 40) v
    FULL JOIN (SELECT * FROM text_ranks WHERE rank <= 40) t USING (query_id, chunk_id)),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM fused)"""


def hybrid_sql(asked: str, select: str, first: str = "") -> str:
    return f"WITH {first}" + HYBRID_CTES.replace("{asked}", asked) + select


@query("hybrid_search", hybrid_sql("{questions}", """
SELECT query_id, rank, chunk_id, symbol, doc_type, period, CAST(page AS BIGINT) AS page, source_url,
  round(score, 9) AS score, vector_rank, text_rank
FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10"""))
def _hybrid_search(t: Tables):
    found = hybrid.hybrid_search(t("questions"), t("chunks"), k=10)
    return found.drop("content").withColumn("score", F.round("score", 9))


@query("indexed_hybrid_search", hybrid_sql("{questions}", """
SELECT query_id, rank, chunk_id, symbol, doc_type, period, CAST(page AS BIGINT) AS page, source_url,
  round(score, 9) AS score, vector_rank, text_rank
FROM ranked JOIN chunks USING (chunk_id) WHERE rank <= 10"""))
def _indexed_hybrid_search(t: Tables):
    """Hybrid search with keywords from the stored index and winners from stored chunks."""
    chunks, index = _stored(t)
    found = hybrid.hybrid_search(t("questions"), chunks, k=10, index=index)
    return found.drop("content").withColumn("score", F.round("score", 9))


@query("rank_fusion", hybrid_sql("{questions}", """
SELECT query_id, chunk_id, round(score, 9) AS score, vector_rank, text_rank FROM fused"""))
def _rank_fusion(t: Tables):
    """The whole fused pool of both channels (candidate pools of 40)."""
    asked, chunks = t("questions"), t("chunks")
    vector = vectors.rank_chunks(asked, chunks, 40)
    text = postings.rank_text(asked, postings.postings_for(asked, chunks), 40, documents=chunks,
                              parts=postings.task_parts(chunks))
    return hybrid.rank_fusion(vector, text).drop("similarity").withColumn("score", F.round("score", 9))


@query("candidate_pool", f"""
WITH {VECTOR_CTES}
SELECT query_id, count(*) AS pool, max(rank) AS last_rank, round(min(score), 6) AS min_score
FROM vector_ranks JOIN (SELECT query_id, 5 + query_id % 16 AS k FROM {{questions}}) USING (query_id)
WHERE rank <= greatest(k * 4, 40) GROUP BY query_id""")
def _candidate_pool(t: Tables):
    """Pool sizes that depend on each question's own k."""
    asked = t("questions").withColumn("k", hybrid.candidate_pool(
        (F.lit(5) + F.col("query_id") % 16).cast("int")))
    return vectors.rank_chunks(asked, t("chunks"), 40).groupBy("query_id").agg(
        F.count("*").alias("pool"), F.max("rank").alias("last_rank"),
        F.round(F.min("score"), 6).alias("min_score"))


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")"
                     for row in pairs)


_PHRASE_ROWS = [
    (i, j, key, term)
    for i, (key, others) in enumerate(keywords.SYNONYMS.items()) if " " in key
    for j, term in enumerate([key, *others])
]
_WORD_ROWS = [
    (key, j, term) for key, others in keywords.SYNONYMS.items() if " " not in key
    for j, term in enumerate(others, 1)
]


def shape_ctes(source: str) -> str:
    """Shaped keyword queries of ``source`` (query_id, question, filter_symbol)."""
    stops = words_sql(keywords.QUESTION_STOP_WORDS)
    return f"""
  phrase_terms(i, j, key, term) AS (VALUES {_values(_PHRASE_ROWS)}),
  word_terms(key, j, term) AS (VALUES {_values(_WORD_ROWS)}),
  drops AS (
    SELECT symbol, unnest(list_append(regexp_extract_all(lower(name), '[a-z0-9]+'), lower(symbol)))
      AS word FROM {{companies}}),
  asked AS (
    SELECT query_id, filter_symbol, regexp_replace(lower(question), '[’'']s\\b', '', 'g') AS q
    FROM {source}),
  asked_words AS (
    SELECT query_id, filter_symbol, unnest(w) AS word, generate_subscripts(w, 1) AS ord
    FROM (SELECT *, regexp_extract_all(q, '[a-z0-9]+') AS w FROM asked)),
  content_words AS (
    SELECT * FROM asked_words a WHERE length(word) >= 3 AND word NOT IN ({stops})
      AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.symbol = a.filter_symbol AND d.word = a.word
                        AND d.word NOT IN ({stops}))),
  shaped_terms AS (
    SELECT query_id, 0 AS part, i AS ord, j, term FROM asked JOIN phrase_terms
      ON contains(q, key)
    UNION ALL SELECT query_id, 1, ord, 0, word FROM content_words
    UNION ALL SELECT query_id, 1, ord, w.j, w.term FROM content_words c JOIN word_terms w
      ON w.key = c.word),
  first_seen AS (
    SELECT query_id, term, min((part, ord, j)) AS place FROM shaped_terms GROUP BY ALL),
  shaped AS (
    SELECT a.query_id, coalesce(string_agg(
      CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END, ' OR ' ORDER BY place), '')
      AS text
    FROM asked a LEFT JOIN first_seen f USING (query_id) GROUP BY a.query_id)"""


@query("shape_keyword_query", f"""
WITH {shape_ctes('{finance_questions}')}
SELECT query_id, text AS keyword_query FROM shaped""")
def _shape_keyword_query(t: Tables):
    return keywords.shape_questions(t("finance_questions"), t("companies")).select(
        "query_id", "keyword_query")


@query("company_drop_terms", f"""
SELECT symbol, string_agg(word, ' ' ORDER BY ord) AS drop_terms FROM (
  SELECT symbol, unnest(w) AS word, generate_subscripts(w, 1) AS ord FROM (
    SELECT symbol, list_prepend(lower(symbol), regexp_extract_all(lower(name), '[a-z0-9]+')) AS w
    FROM {{companies}}))
WHERE word NOT IN ({words_sql(keywords.QUESTION_STOP_WORDS)}) GROUP BY symbol""")
def _company_drop_terms(t: Tables):
    return t("companies").select("symbol", F.array_join(
        keywords.company_drop_terms(F.col("symbol"), F.col("name")), " ").alias("drop_terms"))


RETRIEVE_SQL = f"""{shape_ctes('{questions}')}, """
SUMMARY_CTES = """,
  summary AS (
    SELECT q.query_id, s.text AS keyword_query,
      coalesce((SELECT max(score) FROM sims m WHERE m.query_id = q.query_id), 0) AS max_score,
      (SELECT count(*) FROM ranked r WHERE r.query_id = q.query_id AND rank <= 8) AS n_sources
    FROM {questions} q JOIN shaped s USING (query_id))"""


@query("retrieve_for_questions", hybrid_sql("shaped", SUMMARY_CTES + """
SELECT s.query_id, keyword_query, round(max_score, 6) AS max_score, n_sources, rank, chunk_id,
  vector_rank, text_rank, round(score, 9) AS score
FROM summary s LEFT JOIN (SELECT * FROM ranked WHERE rank <= 8) r ON r.query_id = s.query_id""",
    RETRIEVE_SQL))
def _retrieve_for_questions(t: Tables):
    sources, summary = hybrid.retrieve_for_questions(t("questions"), t("chunks"), t("companies"))
    ranked = sources.select("query_id", "rank", "chunk_id", "vector_rank", "text_rank",
                            F.round("score", 9).alias("score"))
    return summary.drop("question").withColumn("max_score", F.round("max_score", 6)).join(
        ranked, "query_id", "left")


@query("indexed_retrieve_for_questions", hybrid_sql("shaped", SUMMARY_CTES + """
SELECT s.query_id, keyword_query, round(max_score, 6) AS max_score, n_sources, rank, chunk_id,
  vector_rank, text_rank, round(score, 9) AS score
FROM summary s LEFT JOIN (SELECT * FROM ranked WHERE rank <= 8) r ON r.query_id = s.query_id""",
    RETRIEVE_SQL))
def _indexed_retrieve_for_questions(t: Tables):
    """Retrieval for questions from the stored tables."""
    chunks, index = _stored(t)
    sources, summary = hybrid.retrieve_for_questions(t("questions"), chunks, t("companies"), index=index)
    ranked = sources.select("query_id", "rank", "chunk_id", "vector_rank", "text_rank",
                            F.round("score", 9).alias("score"))
    return summary.drop("question").withColumn("max_score", F.round("max_score", 6)).join(
        ranked, "query_id", "left")


@query("confidence_gate", hybrid_sql("shaped", SUMMARY_CTES + """
SELECT query_id, round(max_score, 6) AS max_score, n_sources,
  n_sources = 0 OR max_score < 9e-1 AS refused,
  CASE WHEN n_sources = 0 OR max_score < 9e-1 THEN 0 ELSE n_sources END AS shown_sources
FROM summary""", RETRIEVE_SQL))
def _confidence_gate(t: Tables):
    """A threshold inside the score range of these vectors, so both outcomes occur."""
    _, summary = hybrid.retrieve_for_questions(t("questions"), t("chunks"), t("companies"))
    return hybrid.confidence_gate(summary, 0.9).select(
        "query_id", F.round("max_score", 6).alias("max_score"), "n_sources", "refused",
        "shown_sources")


TOP_VECTOR = f"""
WITH {VECTOR_CTES}, top AS (
  SELECT query_id, rank, c.* FROM vector_ranks JOIN {{chunks}} c USING (chunk_id) WHERE rank <= 8)"""


def _top_sources(t: Tables):
    return vectors.vector_search_filtered(t("questions"), t("chunks"), 8)


@query("build_contexts", TOP_VECTOR + """
SELECT query_id, string_agg('[' || rank || '] (doc_type=' || doc_type || ', period='
  || coalesce(period, 'n/a') || ', page=' || page || ', symbol=' || symbol || ')' || chr(10)
  || content, chr(10) || chr(10) ORDER BY rank) AS context
FROM top GROUP BY query_id""")
def _build_contexts(t: Tables):
    return hybrid.build_contexts(_top_sources(t))


@query("extractive_answers", TOP_VECTOR + f""",
short AS (
  SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS body FROM top WHERE rank <= 3)
SELECT query_id, '{hybrid.EXTRACT_INTRO}' || chr(10) || chr(10) || string_agg(
  CASE WHEN length(body) > 400 THEN left(body, 400) || '…' ELSE body END || ' [' || rank || ']',
  chr(10) || chr(10) ORDER BY rank) AS answer
FROM short GROUP BY query_id""")
def _extractive_answers(t: Tables):
    return hybrid.extractive_answers(_top_sources(t))
