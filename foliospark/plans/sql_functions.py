"""Retrieval as parameterised functions that SQL callers can use.

``register`` makes them over views whose names it is given, so a session's own views stay as
they are. One call searches for one vector or text: a scan, an in-row score and a top-k sort. The
text search reads a stored index (``operators.postings.store_index``) and of it the partitions of
its terms only. Tables of questions go through the DataFrame functions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.functions.text import STOP_WORDS
from foliospark.operators.hybrid import POOL_FACTOR, POOL_FLOOR, RRF_K
from foliospark.operators.postings import StoredIndex

CITATION_LABEL = """
CREATE OR REPLACE TEMPORARY FUNCTION citation_label(
  symbol STRING, doc_type STRING, period STRING, url STRING) RETURNS STRING
RETURN symbol || ' ' || doc_type || coalesce(' (' || period || ')', '') || ' — ' || url
"""

COSINE = """
CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<FLOAT>, b ARRAY<FLOAT>)
RETURNS DOUBLE
RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)
  / (sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)))
     * sqrt(aggregate(b, 0D, (s, x) -> s + double(x) * double(x))))
"""

MATCH_CHUNKS = """
CREATE OR REPLACE TEMPORARY FUNCTION match_chunks(
  query_embedding ARRAY<FLOAT>, match_count INT DEFAULT 8,
  filter_symbol STRING DEFAULT NULL, filter_doc_type STRING DEFAULT NULL,
  filter_period STRING DEFAULT NULL)
RETURNS TABLE (id STRING, content STRING, symbol STRING, doc_type STRING, period STRING,
               page INT, source_url STRING, score DOUBLE)
RETURN SELECT id, content, symbol, doc_type, period, page, source_url, score FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM (
  SELECT c.id, c.content, d.symbol, d.doc_type, d.period, c.page, d.source_url,
         cosine_similarity(c.embedding, match_chunks.query_embedding) AS score
  FROM {chunks} c JOIN {documents} d ON d.id = c.document_id
  WHERE c.embedding IS NOT NULL
    AND (match_chunks.filter_symbol IS NULL OR d.symbol = match_chunks.filter_symbol)
    AND (match_chunks.filter_doc_type IS NULL OR d.doc_type = match_chunks.filter_doc_type)
    AND (match_chunks.filter_period IS NULL OR d.period = match_chunks.filter_period)))
WHERE rn <= match_chunks.match_count
"""


#: Distinct stemmed words of a search text, without stop words. Written out where it is used: a
#: function inside another one's table function is not resolved.
SEARCH_TERMS = """
array_distinct(transform(
  filter(regexp_extract_all(lower(@query), '[\\\\p{L}\\\\p{N}]+', 0), w -> NOT array_contains(array(@stops), w)),
  w -> CASE
    WHEN NOT endswith(w, 's') THEN w
    WHEN endswith(w, 'ies') AND NOT endswith(w, 'eies') AND NOT endswith(w, 'aies')
      THEN substr(w, 1, length(w) - 3) || 'y'
    WHEN endswith(w, 'es') AND NOT endswith(w, 'aes') AND NOT endswith(w, 'ees')
      AND NOT endswith(w, 'oes') THEN substr(w, 1, length(w) - 1)
    WHEN NOT endswith(w, 'us') AND NOT endswith(w, 'ss') THEN substr(w, 1, length(w) - 1)
    ELSE w END))
"""

#: Chunks with any of the words (``match_any``) or with all of them, best first.
SEARCH_CHUNKS = """
CREATE OR REPLACE TEMPORARY FUNCTION search_chunks(
  query STRING, match_count INT DEFAULT 8, match_any BOOLEAN DEFAULT false,
  filter_symbol STRING DEFAULT NULL, filter_doc_type STRING DEFAULT NULL,
  filter_period STRING DEFAULT NULL)
RETURNS TABLE (id STRING, score DOUBLE, rank INT)
RETURN SELECT id, score, rn FROM (
  SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rn FROM (
    SELECT id, met, n_terms, round(gain / n_terms, 9) AS score FROM (
    SELECT CAST(p.chunk_id AS STRING) AS id, count(*) AS met, first(t.n_terms) AS n_terms,
      sum(p.tf / (p.tf + 1)) AS gain
    FROM {postings} p JOIN (
      SELECT /*+ BROADCAST */ term, n_terms, CAST(pmod(xxhash64(term), @buckets) AS INT) AS bucket
      FROM (SELECT size(ts) AS n_terms, explode(ts) AS term FROM (SELECT @terms AS ts))) t
      ON p.term = t.term AND p.bucket = t.bucket
    WHERE (search_chunks.filter_symbol IS NULL OR p.symbol = search_chunks.filter_symbol)
      AND (search_chunks.filter_doc_type IS NULL OR p.doc_type = search_chunks.filter_doc_type)
      AND (search_chunks.filter_period IS NULL OR p.period = search_chunks.filter_period)
    GROUP BY p.chunk_id))
  WHERE search_chunks.match_any OR met = n_terms)
WHERE rn <= search_chunks.match_count
"""

#: Both channels fused by reciprocal ranks; weight 1 is vectors only, 0 text only.
MATCH_HYBRID = f"""
CREATE OR REPLACE TEMPORARY FUNCTION match_chunks_hybrid(
  query_embedding ARRAY<FLOAT>, query STRING, match_count INT DEFAULT 10,
  weight DOUBLE DEFAULT 0.5, match_any BOOLEAN DEFAULT false, filter_symbol STRING DEFAULT NULL,
  filter_doc_type STRING DEFAULT NULL, filter_period STRING DEFAULT NULL)
RETURNS TABLE (id STRING, score DOUBLE, vector_rank INT, text_rank INT, rank INT)
RETURN SELECT id, score, vector_rank, text_rank, rn FROM (
  SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM (
    SELECT coalesce(v.id, t.id) AS id, v.rank AS vector_rank, t.rank AS text_rank, round(
        match_chunks_hybrid.weight * coalesce(1D / ({RRF_K} + v.rank), 0D)
        + (1D - match_chunks_hybrid.weight) * coalesce(1D / ({RRF_K} + t.rank), 0D), 12) AS score
    FROM (
      SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM match_chunks(
        match_chunks_hybrid.query_embedding, @pool, match_chunks_hybrid.filter_symbol,
        match_chunks_hybrid.filter_doc_type, match_chunks_hybrid.filter_period)) v
    FULL JOIN search_chunks(
      match_chunks_hybrid.query, @pool, match_chunks_hybrid.match_any,
      match_chunks_hybrid.filter_symbol, match_chunks_hybrid.filter_doc_type,
      match_chunks_hybrid.filter_period) t ON t.id = v.id))
WHERE rn <= match_chunks_hybrid.match_count
""".replace("@pool", f"greatest({POOL_FACTOR} * match_chunks_hybrid.match_count, {POOL_FLOOR})")


def register(spark: SparkSession, chunks: DataFrame, documents: DataFrame,
             index: StoredIndex | None = None, chunks_view: str = "search_chunks_table",
             documents_view: str = "search_documents_table",
             postings_view: str = "search_postings_table") -> None:
    """The functions for this session, over views of the given names: ``match_chunks``, and
    with a stored index ``search_chunks`` and ``match_chunks_hybrid``."""
    chunks.createOrReplaceTempView(chunks_view)
    documents.createOrReplaceTempView(documents_view)
    made = [CITATION_LABEL, COSINE,
            MATCH_CHUNKS.replace("{chunks}", chunks_view).replace("{documents}", documents_view)]
    if index is not None:
        index.postings.createOrReplaceTempView(postings_view)
        stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
        words = SEARCH_TERMS.replace("@stops", stops).replace("@query", "search_chunks.query")
        made += [SEARCH_CHUNKS.replace("{postings}", postings_view).replace("@terms", words).replace(
            "@buckets", str(index.buckets)), MATCH_HYBRID]
    for statement in made:
        spark.sql(statement)
