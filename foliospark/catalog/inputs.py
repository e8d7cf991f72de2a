"""Inputs of the registered queries, derived from the driver's tables.

Each input is one SELECT in the SQL that Spark and DuckDB share, with tables and other
inputs in braces, so both sides of the check start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import spread

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Tables whose queries work through long texts.
TEXT_TABLES = ("documents", "pages")

INPUTS = {
    # Documents as stored chunks; half of them still wait for their vector.
    "chunks": """
        SELECT d.doc_id AS chunk_id, d.text AS content, d.source AS symbol, d.lang AS doc_type,
          CASE WHEN d.doc_id % 3 = 0 THEN NULL
               ELSE 'FY' || CAST(2020 + d.doc_id % 5 AS STRING) END AS period,
          CAST(d.doc_id % 40 + 1 AS INT) AS page, CAST(NULL AS STRING) AS section,
          'https://files.example.org/' || d.source || '/' || CAST(d.doc_id AS STRING) || '.pdf'
            AS source_url,
          e.embedding AS embedding
        FROM {documents} d LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id""",
    "companies": """
        SELECT 'src' || CAST(n.n_nationkey AS STRING) AS symbol,
          n.n_name || ' ' || r.r_name || ' Limited' AS name,
          'IN' || CAST(1000 + n.n_nationkey AS STRING) AS isin,
          CASE WHEN n.n_nationkey % 4 = 0 THEN NULL ELSE r.r_name END AS industry
        FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey""",
    # Benchmark passages as questions, with a vector and at most one filter each.
    "questions": """
        SELECT b.item_id AS query_id, b.text AS question, b.text AS text,
          e.embedding AS embedding,
          CASE WHEN b.item_id % 4 = 1 THEN 'src' || CAST(b.item_id % 20 AS STRING) END
            AS filter_symbol,
          CASE WHEN b.item_id % 4 = 2 THEN 'en' END AS filter_doc_type,
          CASE WHEN b.item_id % 4 = 3 THEN 'FY2021' END AS filter_period
        FROM {benchmark} b LEFT JOIN {embeddings} e ON e.vec_id = b.item_id""",
    # The same passages as search texts in every form: AND, phrase, OR with exclusion.
    "search_texts": """
        SELECT item_id AS query_id,
          CASE item_id % 3
            WHEN 0 THEN split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)
            WHEN 1 THEN '"' || split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) || '"'
            ELSE split_part(text, ' ', 1) || ' OR "' || split_part(text, ' ', 5) || ' '
              || split_part(text, ' ', 6) || '" OR ' || split_part(text, ' ', 7) || ' -'
              || split_part(text, ' ', 2) END AS text
        FROM {benchmark}""",
    # Questions in words of the trade, about the brand of each part.
    "finance_questions": """
        SELECT p_partkey AS query_id,
          CASE p_partkey % 6
            WHEN 0 THEN 'What did ' || p_name || ' say about capital expenditure and capex?'
            WHEN 1 THEN 'How does ' || p_name || '''s net profit compare with profit after tax?'
            WHEN 2 THEN 'Is the ' || p_type || ' NIM or net interest margin of ' || p_brand || ' up?'
            WHEN 3 THEN 'TCV and deal wins in the last year, per ' || p_name
            WHEN 4 THEN 'what is it and how?'
            ELSE p_name || ' ROE, EPS & free cash flow FY2025-26 for ' || p_brand END AS question,
          CASE WHEN p_partkey % 2 = 0 THEN 'src' || CAST(p_partkey % 25 AS STRING) END
            AS filter_symbol
        FROM {part}""",
    "entities": """
        SELECT DISTINCT upper(replace(p_name, ' ', '')) AS symbol, p_name || ' Limited' AS name
        FROM {part}""",
    # Names as people type them: exact, cut, misspelt, partial.
    "entity_queries": """
        SELECT p_partkey AS query_id,
          CASE p_partkey % 8
            WHEN 0 THEN p_name
            WHEN 1 THEN ' ' || upper(replace(p_name, ' ', '')) || ' '
            WHEN 2 THEN substr(p_name, 1, 4)
            WHEN 3 THEN split_part(p_name, ' ', 2)
            WHEN 4 THEN replace(replace(p_name, ' ', ''), 'i', 'y')
            WHEN 5 THEN substr(split_part(p_name, ' ', 2), 2, 3)
            WHEN 6 THEN split_part(p_name, ' ', 2) || 'z'
            ELSE substr(p_name, 1, 1) || substr(split_part(p_name, ' ', 2), 2) || 't' END AS query
        FROM {part}""",
    "routed_questions": """
        SELECT p_partkey AS question_id,
          CASE p_partkey % 7
            WHEN 0 THEN 'What did ' || replace(p_name, ' ', '') || ' say about margins?'
            WHEN 1 THEN 'What about ' || split_part(p_name, ' ', 2) || ' demand?'
            WHEN 2 THEN 'Compare ' || replace(p_name, ' ', '') || ' and redring this year'
            WHEN 3 THEN 'How is the market doing this quarter?'
            WHEN 4 THEN replace(p_name, ' ', '') || ' against the ' || split_part(p_name, ' ', 1)
              || ' and bolt makers'
            WHEN 5 THEN split_part(p_name, ' ', 1) || ' or ' || split_part(p_name, ' ', 2) || '?'
            ELSE 'Is ' || p_name || ' limited growing' END AS question
        FROM {part}""",
    # One page per document; its lines stand in for blocks and headings.
    "doc_pages": """
        SELECT CAST(doc_id AS STRING) AS document_id, 1 AS page, text FROM {documents}""",
    "corpus_documents": """
        SELECT CAST(o_orderkey AS STRING) AS id, 'src' || CAST(o_custkey % 25 AS STRING) AS symbol,
          CASE o_orderkey % 5 WHEN 0 THEN 'annual_report' WHEN 1 THEN 'announcement'
            ELSE 'concall' END AS doc_type,
          CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'FY' || CAST(2020 + o_orderkey % 5 AS STRING)
            END AS period,
          'https://files.example.org/' || CAST(o_orderkey AS STRING) || '.pdf' AS source_url,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'filings/' || CAST(o_orderkey AS STRING) END
            AS storage_path,
          CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey END AS nse_seq_id,
          o_orderdate AS ingested_at
        FROM {orders}""",
    "corpus_chunks": """
        SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-'
            || CAST(l_partkey AS STRING) AS id,
          CAST(l_orderkey AS STRING) AS document_id, l_linenumber AS page,
          CAST(l_quantity AS INT) AS token_count,
          CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_suppkey END AS vector_of,
          CASE l_returnflag WHEN 'N' THEN NULL WHEN 'A' THEN 'alpha' ELSE 'beta' END
            AS embedding_provider
        FROM {lineitem}""",
    # Events as the announcement feed; every field is text, ids repeat and go missing.
    "announcements": """
        SELECT 'src' || CAST(user_id % 25 AS STRING) AS symbol,
          CASE event_type WHEN 'click' THEN 'Analysts Meet - TRANSCRIPT of call'
            WHEN 'view' THEN 'Annual Report for the year'
            WHEN 'error' THEN 'General update' ELSE NULL END AS desc,
          CASE WHEN event_id % 4 = 0 THEN 'Annual Report and transcript enclosed'
               WHEN event_id % 4 = 1 THEN NULL ELSE 'Copy enclosed' END AS attchmntText,
          CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN ''
               ELSE 'https://feed.example.org/corporate/f' || CAST(event_id % 3000 AS STRING)
                 || '.pdf?dl=1' END AS attchmntFile,
          ts AS ts, event_id AS event_id,
          CASE WHEN event_id % 11 = 0 THEN '-' WHEN event_id % 13 = 0 THEN NULL
               ELSE CAST(100000 + event_id % 3000 AS STRING) END AS seq_id
        FROM {events}""",
    "ledger": """
        SELECT DISTINCT 'seq:' || CAST(100000 + event_id % 3000 AS STRING) AS seen
        FROM {events} WHERE event_type = 'signup'""",
    # Documents as fetched filings; equal texts are equal files.
    "fetched": """
        SELECT doc_id AS filing_id, 'seq:' || CAST(doc_id - doc_id % 2 * CASE WHEN doc_id % 10 = 1
            THEN 1 ELSE 0 END AS STRING) AS ledger_key,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id - doc_id % 2 * CASE WHEN doc_id % 10 = 1
            THEN 1 ELSE 0 END END AS nse_seq_id,
          CASE WHEN doc_id % 17 = 3 THEN NULL ELSE {sha_of_text} END AS sha256,
          CASE WHEN doc_id % 17 = 3 THEN 'HTTP 503' END AS error
        FROM {documents}""",
    "already_stored": """
        SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS nse_seq_id,
          {sha_of_text} AS sha256
        FROM {documents} WHERE lang = 'de'""",
    "requests": """
        SELECT 'u' || CAST(user_id AS STRING) AS ip, ts, event_id AS id FROM {events}""",
    # Assistant turns as answers with citation markers and verdict tags added.
    "answers": """
        SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS request_id,
          conv_id, turn,
          'Question ' || CAST(conv_id AS STRING) AS question,
          CASE (conv_id * 3 + turn) % 9
            WHEN 0 THEN 'ANSWER:' || chr(10) || text || ' [1] and [3, 5]'
            WHEN 1 THEN '**NOT_FOUND**' || chr(10) || text
            WHEN 2 THEN text
            WHEN 3 THEN 'question ' || CAST(conv_id AS STRING) || ': ' || text || ' [2][99]'
            WHEN 4 THEN 'Sorry, this was Not found in the covered filings. ' || text
            WHEN 5 THEN 'answer: **' || text || '** [ 4]'
            WHEN 6 THEN text || ' [1 , 2], [2]'
            WHEN 7 THEN ''
            ELSE '  ANSWER:  ' || text || ' [4]' END AS answer,
          CAST(conv_id % 6 AS INT) AS n_sources,
          conv_id % 10 = 9 AS gate_refused,
          conv_id % 8 = 5 AS failed,
          CASE WHEN conv_id % 12 = 7 THEN 'REFUSE' ELSE 'S' || CAST(turn % 4 AS STRING) END AS expect
        FROM {conversations} WHERE role = 'assistant'""",
    # Ranked sources of those answers: source n of a request has symbol S<n mod 4>.
    "answer_sources": """
        SELECT request_id, CAST(n AS INT) AS rank, 'S' || CAST(n % 4 AS STRING) AS symbol,
          'https://files.example.org/' || request_id || '/' || CAST(n AS STRING) AS source_url
        FROM (SELECT request_id, {explode_sources} FROM {answers} a WHERE n_sources > 0) s""",
    "latency_log": """
        SELECT event_type AS outcome, value AS embed_ms, value * 2 AS retrieve_ms,
          value * 10 + CAST(user_id AS DOUBLE) AS generate_ms,
          value * 13 + CAST(user_id AS DOUBLE) AS total_ms
        FROM {events}""",
    "scores": """
        SELECT doc_id AS query_id, CASE WHEN toxic = 1 THEN 'REFUSE' ELSE 'OK' END AS expect,
          CAST((doc_id * 37) % 80 AS DOUBLE) / 100 AS max_score
        FROM {labels}""",
    "downloads": """
        SELECT CASE WHEN page_id % 3 = 0 THEN 'ci' ELSE 'local' END AS environment, url,
          CAST(length(html) AS BIGINT) AS bytes,
          CAST(page_id % 97 AS DOUBLE) * 25e-1 + 30 AS elapsed_ms,
          CASE WHEN page_id % 23 = 0 THEN 'HTTP 404' END AS error, page_id
        FROM {pages}""",
    "annual_reports": """
        SELECT 'src' || CAST(o_custkey % 25 AS STRING) AS symbol,
          CAST(year(o_orderdate) AS STRING) AS fromYr,
          CAST(year(o_orderdate) + 1 AS STRING) AS toYr,
          'https://feed.example.org/AR_' || CAST(o_orderkey AS STRING)
            || CASE WHEN o_orderkey % 4 = 0 THEN '.ZIP' ELSE '.pdf' END AS fileName,
          CAST(o_totalprice AS STRING) AS attFileSize
        FROM {orders}""",
    # Lines of documents as layout blocks: ten per page, two thirds of the documents in
    # two columns, the first and last of a page in the margin band.
    "lines": """
        SELECT CAST(doc_id AS STRING) AS document_id, doc_id, line_no, line FROM
        (SELECT doc_id, {explode_lines} FROM {documents}) t WHERE length(trim(line)) > 0""",
    "blocks": """
        SELECT document_id, CAST(floor(line_no / 10) AS INT) + 1 AS page,
          CAST(600 AS DOUBLE) AS page_width, CAST(800 AS DOUBLE) AS page_height,
          CASE WHEN doc_id % 3 > 0 AND line_no % 10 BETWEEN 1 AND 8 AND line_no % 2 = 1
               THEN CAST(320 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END AS x0,
          CASE WHEN line_no % 10 = 0 THEN CAST(10 AS DOUBLE) WHEN line_no % 10 = 9 THEN CAST(770 AS DOUBLE)
               ELSE 100 + ((line_no * 7) % 10) * 60 + CAST(doc_id % 4 AS DOUBLE) / 4 END AS y0,
          CASE WHEN doc_id % 3 > 0 AND line_no % 10 BETWEEN 1 AND 8
               THEN CASE WHEN line_no % 2 = 1 THEN CAST(560 AS DOUBLE) ELSE CAST(280 AS DOUBLE) END
               WHEN line_no % 10 IN (0, 9) THEN CAST(200 AS DOUBLE)
               ELSE CAST(560 AS DOUBLE) END AS x1,
          CASE WHEN line_no % 10 = 0 THEN CAST(30 AS DOUBLE) WHEN line_no % 10 = 9 THEN CAST(790 AS DOUBLE)
               ELSE 130 + ((line_no * 7) % 10) * 60 + CAST(doc_id % 4 AS DOUBLE) / 4 END AS y1,
          CASE WHEN line_no % 10 = 9 AND doc_id % 2 = 0
               THEN 'This running  footer of document ' || document_id || ' has more than twelve '
                 || 'words and ends on page ' || CAST(CAST(floor(line_no / 10) AS INT) AS STRING)
               ELSE trim(line) END AS text
        FROM {lines}""",
}

# The spots where the dialects differ.
DIALECT = {
    "spark": {
        "{explode_lines}": "posexplode(split(text, '\\n')) AS (line_no, line)",
        "{explode_sources}": "explode(sequence(1, n_sources)) AS n",
        "{sha_of_text}": "sha2(text, 256)",
    },
    "duckdb": {
        "{explode_lines}": "unnest(string_split(text, chr(10))) AS line, "
                           "generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no",
        "{explode_sources}": "unnest(range(1, n_sources + 1)) AS n",
        "{sha_of_text}": "sha256(text)",
    },
}


def _dialect(sql: str, engine: str) -> str:
    for mark, text in DIALECT[engine].items():
        sql = sql.replace(mark, text)
    return sql


class Tables:
    """The driver's tables and the derived inputs of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        sql = _dialect(INPUTS[name], "spark")
        parts = {n: self(n) for n in re.findall(r"\{(\w+)\}", sql)}
        return self.spark.sql(sql, **parts)


def with_inputs(sql: str) -> str:
    """DuckDB text of a query: the inputs it names in braces become leading CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in INPUTS and name not in needed:
                visit(INPUTS[name])
                needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({_duckdb(INPUTS[n])})" for n in needed]
    body = _duckdb(sql).strip()
    if not ctes:
        return body
    head = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE") else "WITH "
    rest = re.sub(r"(?i)^WITH (RECURSIVE )?", "", body) if body.upper().startswith("WITH") else None
    return head + ",\n".join(ctes) + (f",\n{rest}" if rest is not None else f"\n{body}")


def _duckdb(sql: str) -> str:
    sql = _dialect(sql, "duckdb")
    sql = re.sub(r"(?<![\w.'])desc(?=[,\s]|$)(?! NULLS)", '"desc"', sql) if " AS desc" in sql else sql
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def canonical(df: DataFrame) -> DataFrame:
    """Plain wide types for the comparison: long, double, string, boolean."""
    wide = {T.IntegerType: "bigint", T.ShortType: "bigint", T.FloatType: "double"}
    return df.select(*(
        F.col(f.name).cast(wide[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in wide else F.col(f.name) for f in df.schema.fields))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``fn(tables)`` as a query, and its SQL when SQL can express it."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return canonical(fn(Tables(spark, sf_dir)))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle)
        return fn

    return wrap
