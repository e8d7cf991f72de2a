"""Registered queries: layout, sentences, chunks, quality flags and embedding jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.catalog.inputs import Tables, query
from foliospark.functions import text as ft
from foliospark.operators import chunking, embedding, layout, quality
from foliospark.plans import ingest as ingest_plan
from foliospark.session import shared_folder

SOLID = "length(regexp_replace(text, '\\s+', '', 'g'))"
IN_BAND = "(y1 <= 45 OR y0 >= page_height - 45)"
WORDS = "len(regexp_extract_all(text, '\\S+'))"
KEY = "regexp_replace(regexp_replace(lower(trim(text)), '\\d+', '#', 'g'), '\\s+', ' ', 'g')"

LAYOUT_CTES = f"""
  b AS (SELECT *, {IN_BAND} AS band, {WORDS} AS n_words, {KEY} AS key FROM {{blocks}}),
  repeats AS (
    SELECT document_id, key FROM b WHERE band GROUP BY ALL HAVING count(DISTINCT page) >= 2),
  kept AS (
    SELECT b.*, NOT (band AND (n_words <= 12 OR r.key IS NOT NULL)) AS kept
    FROM b LEFT JOIN repeats r ON r.document_id = b.document_id AND r.key = b.key),
  shape AS (
    SELECT document_id, page,
      NOT bool_or(x0 < page_width / 2 - page_width * 2e-2 AND x1 > page_width / 2 + page_width * 2e-2)
        AND count(*) FILTER ((x0 + x1) / 2 < page_width / 2) >= 3
        AND count(*) FILTER ((x0 + x1) / 2 >= page_width / 2) >= 3 AS two_column
    FROM b GROUP BY ALL),
  ordered AS (
    SELECT k.*, two_column, row_number() OVER (PARTITION BY document_id, page ORDER BY
      CASE WHEN two_column THEN CAST((x0 + x1) / 2 >= page_width / 2 AS INT) ELSE round_even(y0, 0) END,
      CASE WHEN two_column THEN y0 ELSE x0 END, x0, y0, y1, text) AS ord
    FROM kept k JOIN shape USING (document_id, page))"""


@query("reading_order", f"""WITH {LAYOUT_CTES}
SELECT document_id, CAST(page AS BIGINT) AS page, ord, two_column, text FROM ordered""")
def _reading_order(t: Tables):
    return layout.reading_order(t("blocks")).select(
        "document_id", "page", "ord", "two_column", "text")


@query("strip_margins", f"""WITH {LAYOUT_CTES}
SELECT document_id, CAST(page AS BIGINT) AS page, x0, y0, text, kept FROM kept""")
def _strip_margins(t: Tables):
    return layout.strip_margins(t("blocks")).select(
        "document_id", "page", "x0", "y0", "text", "kept")


@query("repeat_key", f"""
SELECT doc_id, {KEY} AS repeat_key FROM {{documents}}""")
def _repeat_key(t: Tables):
    return t("documents").select("doc_id", ft.repeat_key(F.col("text")).alias("repeat_key"))


@query("assemble_pages", f"""WITH {LAYOUT_CTES}
SELECT document_id, CAST(page AS BIGINT) AS page,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (kept), '') AS text
FROM ordered GROUP BY document_id, page""")
def _assemble_pages(t: Tables):
    return layout.extract_pages(t("blocks"))


HEADING_CTES = """
  parts AS (
    SELECT document_id, page, unnest(b) AS block, generate_subscripts(b, 1) AS ord
    FROM (SELECT document_id, page, string_split(text, chr(10)) AS b FROM {doc_pages})),
  placed AS (
    SELECT document_id, page, trim(block) AS heading,
      coalesce(sum(length(block) + 1) OVER (PARTITION BY document_id, page ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
    FROM parts),
  headings AS (
    SELECT document_id, page, CAST("offset" AS BIGINT) AS "offset", heading FROM placed
    WHERE regexp_matches(heading, '\\p{{L}}') AND NOT regexp_matches(heading, '^[•\\-*\\t]')
      AND NOT regexp_matches(heading, '[.!?]$')
      AND len(regexp_extract_all(heading, '\\S+')) BETWEEN 1 AND 10)""".replace("{{L}}", "{L}")


@query("detect_headings", f"""WITH {HEADING_CTES}
SELECT document_id, CAST(page AS BIGINT) AS page, "offset", heading FROM headings""")
def _detect_headings(t: Tables):
    """Lines stand in for blank-line blocks, which the documents do not have."""
    return chunking.detect_headings(t("doc_pages"), "\n")


SENTENCES_SQL = r"""
  marked AS (
    SELECT document_id, page, text,
      regexp_replace(text, '([.!?])(\s+[A-Z"''(])', '\1' || chr(1) || '\2', 'g') AS m
    FROM {doc_pages}),
  pieces AS (
    SELECT document_id, page, text, unnest(p) AS piece, generate_subscripts(p, 1) AS ord, len(p) AS n
    FROM (SELECT *, string_split(m, chr(1)) AS p FROM marked)),
  cut AS (
    SELECT *, regexp_replace(piece, '\s+$', '') AS body,
      sum(length(piece)) OVER (PARTITION BY document_id, page ORDER BY ord) AS pos
    FROM pieces),
  flagged AS (
    SELECT *, regexp_matches(body, '[.!?]$') AND lower(regexp_extract(body,
      '([\p{L}\p{N}_]+)[.!?]*$', 1)) NOT IN (ABBREVIATIONS) AS ends FROM cut),
  numbered AS (
    SELECT *, coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, page
      ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS sid
    FROM flagged),
  grouped AS (
    SELECT document_id, page, sid, any_value(text) AS text, min(pos - length(piece)) AS lo,
      max(pos) AS hi, bool_or(ends) AS ended FROM numbered GROUP BY document_id, page, sid),
  sentences AS (
    SELECT document_id, page, sid AS ord, text,
      CASE WHEN ended THEN lo ELSE lo + length(raw) - length(regexp_replace(raw, '^\s+', '')) END
        AS "start",
      lo + length(regexp_replace(raw, '\s+$', '')) AS "end",
      trim(raw, ' ' || chr(10) || chr(9) || chr(13)) AS sentence
    FROM (SELECT *, substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)) AS raw FROM grouped)
    WHERE regexp_matches(raw, '\S'))""".replace(
    "ABBREVIATIONS", ", ".join(f"'{w}'" for w in chunking.ABBREVIATIONS))


@query("segment_sentences", f"""WITH {SENTENCES_SQL}
SELECT document_id, CAST(page AS BIGINT) AS page, CAST(ord AS BIGINT) AS ord,
  CAST("start" AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end", sentence FROM sentences""")
def _segment_sentences(t: Tables):
    return chunking.segment_sentences(t("doc_pages"))


@query("assign_section", f"""WITH {HEADING_CTES}, {SENTENCES_SQL}
SELECT s.document_id, CAST(s.page AS BIGINT) AS page, CAST(s."start" AS BIGINT) AS "start",
  h.heading AS section
FROM sentences s ASOF LEFT JOIN headings h
  ON h.document_id = s.document_id AND h.page = s.page AND h."offset" <= s."start\"""")
def _assign_section(t: Tables):
    """Nearest heading at or before each sentence, as a job over two tables."""
    pages = t("doc_pages")
    return chunking.assign_sections(
        chunking.segment_sentences(pages), chunking.detect_headings(pages, "\n"))


# Packing as a recursive walk from sentence border to sentence border.
PACKING_SQL = """
  RECURSIVE_SENTENCES,
  s AS (
    SELECT document_id, page, row_number() OVER w AS i, "start", "end",
      CAST(coalesce(sum(tok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS before,
      CAST(sum(tok) OVER w AS BIGINT) AS after
    FROM (SELECT *, len(regexp_extract_all(sentence, '\\S+')) AS tok FROM sentences)
    WINDOW w AS (PARTITION BY document_id, page ORDER BY ord)),
  reach AS (
    SELECT a.document_id, a.page, a.i, a."start",
      greatest(max(b.i) FILTER (b.after - a.before <= 200), a.i) AS j
    FROM s a JOIN s b ON a.document_id = b.document_id AND a.page = b.page AND b.i >= a.i
      AND (b.after - a.before <= 200 OR b.i = a.i)
    GROUP BY a.document_id, a.page, a.i, a."start"),
  steps AS (
    SELECT r.document_id, r.page, r.i, r.j, r."start", e."end", e.after,
      greatest(coalesce((SELECT max(k.i) FROM s k WHERE k.document_id = r.document_id
        AND k.page = r.page AND k.i <= r.j AND e.after - k.before >= 40), 0), r.i + 1) AS next_i
    FROM reach r JOIN s e ON e.document_id = r.document_id AND e.page = r.page AND e.i = r.j),
  ends AS (SELECT document_id, page, max(i) AS n FROM s GROUP BY ALL),
  walk AS (
    SELECT document_id, page, i, j, "start", "end", next_i FROM steps WHERE i = 1
    UNION ALL
    SELECT n.document_id, n.page, n.i, n.j, n."start", n."end", n.next_i
    FROM walk w JOIN ends e ON e.document_id = w.document_id AND e.page = w.page AND w.j < e.n
    JOIN steps n ON n.document_id = w.document_id AND n.page = w.page AND n.i = w.next_i)"""


CHUNKS_SQL = f"""WITH RECURSIVE {HEADING_CTES}, {PACKING_SQL.replace("RECURSIVE_SENTENCES", SENTENCES_SQL)},
  sliced AS (
    SELECT w.document_id, w.page, w."start", trim(substr(p.text, CAST(w."start" + 1 AS BIGINT),
      CAST(w."end" - w."start" AS BIGINT)), ' ' || chr(10) || chr(9) || chr(13)) AS content
    FROM walk w JOIN {{doc_pages}} p ON p.document_id = w.document_id AND p.page = w.page)"""


@query("chunk_pages", CHUNKS_SQL + """
SELECT sha256(c.document_id || '|' || c.page || '|' || CAST(c."start" AS BIGINT)) AS id,
  c.document_id, CAST(c.page AS BIGINT) AS page, CAST(c."start" AS BIGINT) AS "start",
  h.heading AS section, content, len(regexp_extract_all(content, '\\S+')) AS token_count
FROM sliced c ASOF LEFT JOIN headings h
  ON h.document_id = c.document_id AND h.page = c.page AND h."offset" <= c."start\"""")
def _chunk_pages(t: Tables):
    """Small chunks (200 tokens, 40 overlap), so that packing and overlap both work hard."""
    return chunking.chunk_pages(t("doc_pages"), 200, 40, "\n")


@query("token_count", """
SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS token_count FROM {documents}""")
def _token_count(t: Tables):
    return t("documents").select("doc_id", ft.token_count(F.col("text")).alias("token_count"))


UUID_SQL = """
SELECT doc_id, key, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
  || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-'
  || substr(h, 21, 12) AS uuid
FROM (SELECT doc_id, key, sha1(unhex('6a6e2b0e6b7b4f349f2e9d6b6f5c8e3d') || encode(key)) AS h
  FROM (SELECT doc_id, sha256(CAST(doc_id AS STRING) || '|' || CAST(doc_id % 40 + 1 AS STRING)
    || '|' || CAST(n_chars AS STRING)) AS key FROM {documents}))"""


@query("chunk_key", UUID_SQL)
def _chunk_key(t: Tables):
    key = ft.chunk_key(F.col("doc_id"), F.col("doc_id") % 40 + 1, F.col("n_chars"))
    return t("documents").select("doc_id", key.alias("key")).withColumn("uuid", ft.uuid5(F.col("key")))


# Pages with extraction debris added to whole documents.
DEBRIS_SQL = """
SELECT CAST(doc_id AS STRING) AS document_id, CAST(doc_id % 9 AS INT) AS page,
  CASE doc_id % 8 WHEN 0 THEN text || ' (cid:12)(cid:7)'
    WHEN 1 THEN repeat('�', CAST(floor(n_chars / 20) AS INT)) || text
    WHEN 2 THEN '� ' || text WHEN 3 THEN ' p. ' || CAST(doc_id AS STRING) || ' '
    ELSE text END AS text
FROM {documents}"""


@query("flag_low_quality_pages", f"""
WITH p AS ({DEBRIS_SQL}), m AS (
  SELECT document_id, page, {SOLID} AS chars, len(regexp_extract_all(text, '\\(cid:\\d+\\)')) AS cid,
    length(text) - length(replace(text, '�', '')) AS garbled FROM p)
SELECT document_id, CAST(page AS BIGINT) AS page,
  CASE WHEN chars < 20 THEN '{quality.NEAR_EMPTY}' ELSE '{quality.GARBAGE}' END AS reason,
  CASE WHEN chars < 20 THEN chars || ' chars'
    ELSE cid || ' cid marker(s), ' || garbled || ' replacement char(s)' END AS detail
FROM m WHERE chars < 20 OR cid > 0 OR garbled / chars > 2e-2""")
def _flag_low_quality_pages(t: Tables):
    return quality.flag_low_quality_pages(t.spark.sql(DEBRIS_SQL, documents=t("documents")))


@query("flag_thin_documents", f"""
SELECT document_id, count(*) AS pages, CAST(sum({SOLID}) AS BIGINT) AS chars
FROM (SELECT lang || '-' || CAST(doc_id - doc_id % 2 AS STRING) AS document_id, text FROM {{documents}})
GROUP BY document_id HAVING sum({SOLID}) < 2000""")
def _flag_thin_documents(t: Tables):
    pages = t("documents").select(
        F.concat_ws("-", "lang", (F.col("doc_id") - F.col("doc_id") % 2).cast("string")).alias("document_id"),
        "text")
    return quality.flag_thin_documents(pages)


def letter_profile(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in embedder: how often each letter occurs."""
    return [[float(text.count(ch)) for ch in "abcdefghijklmnopqrstuvwxyz"] for text in texts]


PROFILE_SQL = """
  profile AS (
    SELECT doc_id, CAST(position(ch IN 'abcdefghijklmnopqrstuvwxyz') - 1 AS BIGINT) AS dim,
      CAST(length(text) - length(replace(text, ch, '')) AS DOUBLE) AS value
    FROM {documents}, (SELECT unnest(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z',
      ' ')) AS ch))"""


@query("embed_batches", f"""WITH {PROFILE_SQL}
SELECT doc_id AS id, dim, value, 'letters' AS embedding_provider, 'embedded' AS status FROM profile""")
def _embed_batches(t: Tables):
    chunks = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    done = embedding.embed_batches(chunks, letter_profile, "letters", backoff=0)
    return done.select("id", F.posexplode("embedding").alias("dim", "value"),
                       "embedding_provider", "status")


def _stored(t: Tables):
    """Corpus chunks with their vectors: three states in two providers."""
    vecs = t("embeddings").select(F.col("vec_id").alias("vector_of"), "embedding")
    return t("corpus_chunks").join(vecs, "vector_of", "left")


@query("pending_chunks", """
SELECT c.id, c.document_id, CAST(c.page AS BIGINT) AS page
FROM {corpus_chunks} c WHERE NOT EXISTS (
  SELECT 1 FROM {corpus_chunks} s JOIN {embeddings} e ON e.vec_id = s.vector_of
  WHERE s.id = c.id AND s.embedding_provider = 'alpha')""")
def _pending_chunks(t: Tables):
    return embedding.pending_chunks(
        t("corpus_chunks"), _stored(t), "alpha").select("id", "document_id", "page")


@query("embed_summary", """
SELECT count(*) AS total, count(embedding) AS skipped,
  count(*) FILTER (embedding IS NULL AND chunk_id % 7 <> 3) AS embedded,
  count(*) FILTER (embedding IS NULL AND chunk_id % 7 = 3) AS failed FROM {chunks}""")
def _embed_summary(t: Tables):
    """Counts observed while an embedder that fails for every seventh chunk writes its rows."""

    def failing(texts: list[str]) -> list[list[float]]:
        if any(int(x) % 7 == 3 for x in texts):
            raise RuntimeError("down")
        return [[float(x)] for x in texts]

    chunks = t("chunks").select(F.col("chunk_id").alias("id"),
                                F.col("chunk_id").cast("string").alias("content"), "embedding")
    done = chunks.filter("embedding IS NOT NULL").select("id", F.lit("p").alias("embedding_provider"))
    path = shared_folder(t.spark, "embedded")
    counts = embedding.embed_pending(
        chunks.drop("embedding"), done, failing, "p", lambda rows: rows.write.parquet(path),
        batch_size=1, tries=1)
    written = embedding.embed_summary(counts["total"], t.spark.read.parquet(path)).first()
    if written.asDict() != counts:
        raise RuntimeError(f"observed {counts}, written {written}")
    return t.spark.createDataFrame([counts], "total bigint, skipped bigint, embedded bigint, failed bigint")


@query("l2_normalise", """
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round(CAST(v AS DOUBLE) / sqrt(norm2), 6) AS value FROM (
  SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim,
    list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm2
  FROM {embeddings})""")
def _l2_normalise(t: Tables):
    unit = embedding.l2_normalise(F.col("embedding"))
    return t("embeddings").select("vec_id", F.posexplode(unit).alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("check_vector_space", """
SELECT s.embedding_provider, CAST(len(e.embedding) AS BIGINT) AS dimensions, count(*) AS vectors
FROM {corpus_chunks} s JOIN {embeddings} e ON e.vec_id = s.vector_of GROUP BY ALL""")
def _check_vector_space(t: Tables):
    return embedding.check_vector_space(_stored(t))


@query("ingest_pages", CHUNKS_SQL.replace("<= 200", "<= 800").replace(">= 40", ">= 100") + """
SELECT 'skipped' AS status, count(*) AS chunks FROM sliced""")
def _ingest_pages(t: Tables):
    """Pages to chunks to vectors; a second run over the result has nothing left to do."""
    pages = t("doc_pages")
    empty = t.spark.createDataFrame(
        [], "id string, embedding array<float>, embedding_provider string")
    written, _ = ingest_plan.ingest(pages, empty, letter_profile, "letters", separator="\n", backoff=0)
    _, again = ingest_plan.ingest(pages, written, letter_profile, "letters", separator="\n", backoff=0)
    return again.groupBy("status").agg(F.count("*").alias("chunks"))


ASSEMBLED_SQL = f"""(WITH {LAYOUT_CTES}
  SELECT document_id, CAST(page AS BIGINT) AS page,
    coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ord) FILTER (kept), '') AS text
  FROM ordered GROUP BY document_id, page)"""


@query("ingest_blocks", CHUNKS_SQL.replace("<= 200", "<= 800").replace(">= 40", ">= 100").replace(
    "WITH RECURSIVE ", f"WITH RECURSIVE assembled AS {ASSEMBLED_SQL}, ").replace(
    "{doc_pages}", "assembled") + """
SELECT document_id, count(*) AS chunks,
  CAST(sum(len(regexp_extract_all(content, '\\S+'))) AS BIGINT) AS tokens, 'letters' AS embedding_provider
FROM sliced GROUP BY document_id""")
def _ingest_blocks(t: Tables):
    """Layout blocks to pages, chunks and vectors: what is stored of each document."""
    empty = t.spark.createDataFrame(
        [], "id string, embedding array<float>, embedding_provider string")
    written, _ = ingest_plan.ingest_blocks(t("blocks"), empty, letter_profile, "letters",
                                           separator="\n", backoff=0)
    return written.groupBy("document_id", "embedding_provider").agg(
        F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query("run_generator", """
SELECT query_id, 'Q' || length(question) AS answer, query_id % 5 = 0 AS failed FROM (
  SELECT * FROM {questions} WHERE query_id % 5 <> 0)
UNION ALL SELECT query_id, NULL, TRUE FROM {questions} WHERE query_id % 5 = 0""")
def _run_generator(t: Tables):
    """A primary that fails on some prompts, a secondary that fails on fewer."""

    def primary(prompt: str, system: str | None) -> str:
        if int(prompt.split("|")[0]) % 3 == 0:
            raise RuntimeError("quota")
        return secondary(prompt, system)

    def secondary(prompt: str, system: str | None) -> str:
        number, text = prompt.split("|", 1)
        if int(number) % 5 == 0:
            raise RuntimeError("quota")
        return f"Q{len(text)}"

    prompts = t("questions").select(
        "query_id", F.concat_ws("|", F.col("query_id").cast("string"), "question").alias("prompt"))
    return embedding.run_generator(prompts, primary, secondary).select("query_id", "answer", "failed")
