"""Resolving names to entities, and routing questions by the entities they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import strip, word_set
from foliospark.operators.matching import in_order, is_subsequence, similar, within
from foliospark.session import broadcast_if_small, pin_small, stored

# Words that never identify an entity when routing.
ROUTING_STOP_WORDS = (
    "the", "a", "an", "of", "for", "on", "in", "to", "and", "or", "with", "at", "by", "is", "are",
    "was", "were", "be", "been", "do", "does", "did", "has", "have", "had", "what", "which", "who",
    "how", "why", "when", "where", "whats", "say", "said", "says", "tell", "told", "mention",
    "mentioned", "comment", "comments", "about", "regarding", "their", "its", "they", "this",
    "that", "these", "those", "last", "recent", "latest", "quarter", "quarterly", "annual", "year",
    "fy", "revenue", "revenues", "margin", "margins", "growth", "guidance", "outlook", "results",
    "result", "report", "reports", "dividend", "demand", "risk", "risks", "business", "market",
    "share", "shares", "price", "earnings", "call", "transcript", "filing", "filings", "management",
    "board", "company", "companies", "limited", "ltd", "bank", "services", "industries",
)

STRONG_SCORE = 700
MIN_TOKEN_CHARS = 3
MAX_SPAN_WORDS = 3
#: Edits that a typo match allows, as a share of the longer text: of a symbol, and of a word, which
#: also has to be of about the query's length.
SYMBOL_EDITS, WORD_EDITS, WORD_GAP = 0.4, 0.3, 2
MAX_KEYS = 200_000


def _name_words(name: Column) -> Column:
    return F.filter(F.split(name, "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def _similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 once the edits pass half the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    bound = F.ceil(longer * 0.5).cast("int")
    edits = F.call_function("levenshtein", a, b, bound)
    return F.when(longer == 0, F.lit(1.0)).when(edits < 0, F.lit(0.0)).otherwise(
        F.lit(1.0) - edits / longer)


def strong_score(query: Column, symbol: Column, name: Column, words: Column) -> Column:
    """Score of the rules that identify an entity beyond doubt, null when none applies."""
    return (
        F.when(symbol == query, 1000)
        .when(F.startswith(symbol, query), 900 - (F.length(symbol) - F.length(query)))
        .when(name == query, 850)
        .when(F.array_contains(words, query), 820)
        .when(F.exists(words, lambda w: F.startswith(w, query)), 700)
    )


def match_score(query: Column, symbol: Column, name: Column, words: Column) -> Column:
    """Score of one entity for a trimmed lower-case query; symbol, name and words are
    lower case too. Substring matches score 400 and up, typo matches at most 200."""
    sym_sim = _similarity(query, symbol)
    close = F.filter(words, lambda w: F.abs(F.length(w) - F.length(query)) <= 2)
    word_scores = F.transform(close, lambda w: _similarity(query, w))
    word_fuzzy = F.array_max(F.transform(
        word_scores, lambda s: F.when(s >= 0.7, F.round(s * 150)).otherwise(0.0)))
    fuzzy = F.greatest(
        F.when(sym_sim >= 0.6, F.round(sym_sim * 200)).otherwise(0.0),
        F.coalesce(word_fuzzy, F.lit(0.0)),
    ).cast("int")
    loose = F.when(
        (F.length(query) >= 3) & is_subsequence(query, symbol), 120).otherwise(0)
    inside = F.when(F.contains(symbol, query), 601 - F.instr(symbol, query)).when(
        F.contains(name, query), 500 - F.least(F.instr(name, query) - 1, F.lit(99)))
    return F.coalesce(strong_score(query, symbol, name, words), inside,
                      F.when(fuzzy > 0, fuzzy), loose)


def entity_candidates(queries: DataFrame, entities: DataFrame) -> DataFrame:
    """(query, symbol, name): the pairs that some rule can give a score, of distinct trimmed
    lower-case texts ``query`` with entities.

    Distinct symbols, names and words are matched, not entities: a word of many names is
    looked at once. Every rule of ``match_score`` has its keys: what begins with, equals or
    contains the query contains it; typo matches share a segment; loose ones three characters.
    """
    queries = stored(queries.select("query").distinct(), "asked")
    sym, low = F.lower("symbol"), F.lower("name")

    def of_kind(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    # What the rules look at: parts of symbol and name, the symbol, the words of the name.
    looked_at = F.concat(of_kind("part", F.array(sym, low)), of_kind("symbol", F.array(sym)),
                         of_kind("word", F.coalesce(F.array_distinct(_name_words(low)), F.array())))
    keyed = stored(entities.select("symbol", "name").distinct().select(
        "symbol", "name", F.inline(looked_at)).filter("text <> ''"), "entities")

    def texts(kind: str) -> DataFrame:
        return keyed.filter(F.col("kind") == kind).select("text").distinct()

    found = [("part", within(queries, texts("part"))),
             ("symbol", similar(queries, texts("symbol"), SYMBOL_EDITS)),
             ("symbol", in_order(queries, texts("symbol"))),
             ("word", similar(queries, texts("word"), WORD_EDITS, WORD_GAP))]
    first, *others = [f.select("query", F.lit(kind).alias("kind"), "text") for kind, f in found]
    for other in others:
        first = first.unionByName(other)
    return first.join(keyed, ["kind", "text"]).select("query", "symbol", "name").distinct()


def score_entities(queries: DataFrame, entities: DataFrame, limit: int | None = 5) -> DataFrame:
    """(query, symbol, name, score, rank): best entities per distinct query text, or with
    ``limit`` None all of a positive score.

    Only candidate pairs are scored. Rows that repeat a symbol and a name are one entity.
    """
    asked = queries.select(F.lower(strip(F.col("query"))).alias("query")).filter(
        "query <> ''").distinct()
    low = F.lower("name")
    score = match_score(F.col("query"), F.lower("symbol"), low, _name_words(low))
    scored = entity_candidates(asked, entities).withColumn("score", score).filter("score > 0")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "symbol", "name")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("query", "symbol", "name", "score", "rank")


def search_entities(queries: DataFrame, entities: DataFrame, limit: int = 5) -> DataFrame:
    """(query_id, rank, symbol, name, score) for rows (query_id, query)."""
    found = score_entities(queries, entities, limit)
    asked = queries.select("query_id", F.lower(strip(F.col("query"))).alias("query"))
    return asked.join(found, "query").select("query_id", "rank", "symbol", "name", "score")


def entity_keys(entities: DataFrame, min_chars: int = MIN_TOKEN_CHARS) -> DataFrame:
    """(key, symbol, score): every text that names an entity with a strong score.

    The strong rules are all equalities once the prefixes are spelled out, so routing is
    an equi-join on the span text and compares nothing else.
    """
    sym, name = F.lower("symbol"), F.lower("name")

    def prefixes(text: Column) -> Column:
        return F.when(F.length(text) >= min_chars, F.transform(
            F.sequence(F.lit(min_chars), F.length(text)),
            lambda n: text.substr(F.lit(1), n))).otherwise(F.array().cast("array<string>"))

    def keyed(texts: Column, order: int, score: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(
            t.alias("key"), F.lit(order).alias("order"), score.alias("score")))

    words = _name_words(name)
    all_keys = F.concat(
        keyed(F.array(sym), 1, F.lit(1000)),
        F.transform(prefixes(sym), lambda t: F.struct(
            t.alias("key"), F.lit(2).alias("order"),
            (900 - (F.length(sym) - F.length(t))).alias("score"))),
        keyed(F.array(name), 3, F.lit(850)),
        keyed(words, 4, F.lit(820)),
        keyed(F.flatten(F.transform(words, prefixes)), 5, F.lit(700)),
    )
    rows = entities.select("symbol", F.inline_outer(all_keys)).filter(F.length("key") >= min_chars)
    return (
        rows.groupBy("key", "symbol").agg(F.min_by("score", "order").alias("score"))
        .filter(F.col("score") >= STRONG_SCORE)
    )


def key_winners(entities: DataFrame) -> DataFrame:
    """(key, symbol, top, n_winners): the entities with the top score of each key."""
    keys = entity_keys(entities)
    tops = keys.groupBy("key").agg(F.max("score").alias("top"))
    winners = keys.join(tops, "key").filter(F.col("score") == F.col("top"))
    sizes = winners.groupBy("key").agg(F.count("*").alias("n_winners"))
    return winners.join(sizes, "key").select("key", "symbol", "top", "n_winners")


def question_spans(questions: DataFrame) -> DataFrame:
    """(question_id, n, i, span): runs of 1 to 3 words, unless all are stop words or
    short."""
    tokens = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9&]+"), F.lit(0))

    def of_length(n: int) -> Column:
        def run(i: Column) -> Column:
            return F.struct(F.lit(n).alias("n"), i.alias("i"),
                            F.slice("_tokens", i, F.lit(n)).alias("words"))

        starts = F.sequence(F.lit(1), F.size("_tokens") - (n - 1))
        return F.when(F.size("_tokens") >= n, F.transform(starts, run)).otherwise(
            F.expr("cast(array() as array<struct<n:int,i:int,words:array<string>>>)"))

    runs = F.concat(*(of_length(n) for n in range(1, MAX_SPAN_WORDS + 1)))
    empty = F.forall("words", lambda w: F.array_contains(word_set(ROUTING_STOP_WORDS), w)
                     | (F.length(w) < MIN_TOKEN_CHARS))
    return (
        questions.select("question_id", tokens.alias("_tokens"))
        .select("question_id", F.inline_outer(runs)).filter(~empty)
        .select("question_id", "n", "i", F.array_join("words", " ").alias("span"))
    )


def route_questions(questions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, choices) for rows (question_id, question).

    decisions: question_id, kind ('none', 'scope', 'choose'), reason. choices:
    question_id, choice_rank, symbol, name. A span meets the key table once; its
    question then has one short list of named spans and decides on that inside its row.
    The members of a chosen group are added at the end, so a name shared by many
    entities is not multiplied by the questions that mention it.
    """
    winners, small = pin_small(
        key_winners(entities).join(entities.select("symbol", "name"), "symbol"), MAX_KEYS)
    keys = winners.groupBy("key").agg(
        F.first("top").alias("top"), F.first("n_winners").alias("size"),
        F.min_by("name", "symbol").alias("name"), F.min("symbol").alias("symbol"))
    spans = question_spans(questions).withColumnRenamed("span", "key").join(
        broadcast_if_small(keys, MAX_KEYS, small or None), "key")
    named = spans.groupBy("question_id").agg(
        F.collect_list(F.struct("n", "i", "key", "size", "top", "symbol", "name")).alias("_spans"))

    # Entities named beyond doubt, best first; groups of equally good ones in reading order.
    single = F.sort_array(F.transform(
        F.filter("_spans", lambda s: s["size"] == 1),
        lambda s: F.struct((-s["top"]).alias("neg"), s["symbol"].alias("symbol"),
                           s["name"].alias("name"))))
    groups = F.sort_array(F.filter("_spans", lambda s: s["size"] > 1))
    listed = named.select("question_id", single.alias("_single"), groups.alias("_groups")).select(
        "question_id", "_groups",
        F.filter("_single", lambda s, at: F.array_position(
            F.transform("_single", lambda o: o["symbol"]), s["symbol"]) == at + 1)
        .alias("_decisive"))
    only = F.get("_decisive", F.lit(0))
    low = F.lower(only["name"])

    def without_only(group: Column) -> Column:
        score = strong_score(group["key"], F.lower(only["symbol"]), low, _name_words(low))
        return F.coalesce(score, F.lit(0)) != group["top"]

    by_size = F.sort_array(F.transform("_groups", lambda g: F.struct(
        g["size"].alias("size"), g["n"].alias("n"), g["i"].alias("i"), g["key"].alias("key"))))
    facts = listed.select(
        "question_id", "_decisive", F.size("_decisive").alias("_n"),
        F.when(F.size("_decisive") == 1, F.get(F.filter("_groups", without_only), F.lit(0))["key"])
        .alias("_other"),
        F.get(by_size, F.lit(0))["key"].alias("_group"),
    )
    decided = questions.select("question_id").join(facts, "question_id", "left").withColumn(
        "_n", F.coalesce("_n", F.lit(0))).withColumn(
        "reason",
        F.when((F.col("_n") >= 2) | F.col("_other").isNotNull(), F.lit("multiple"))
        .when((F.col("_n") == 0) & F.col("_group").isNotNull(), F.lit("ambiguous")))
    decided = stored(decided, "routes")  # one short row per question, read twice below
    decisions = decided.select(
        "question_id",
        F.when(F.col("reason").isNotNull(), F.lit("choose"))
        .when(F.col("_n") == 1, F.lit("scope")).otherwise(F.lit("none")).alias("kind"), "reason")

    first = decided.select("question_id", F.posexplode_outer("_decisive").alias("_at", "_e")).filter(
        "_at IS NOT NULL").select(
        "question_id", (F.col("_at") + 1).alias("choice_rank"), F.col("_e.symbol").alias("symbol"),
        F.col("_e.name").alias("name"))
    shown = F.when(F.col("reason") == "ambiguous", F.col("_group")).otherwise(F.col("_other"))
    by_symbol = Window.partitionBy("key").orderBy("symbol")
    members = winners.select("key", "symbol", "name", F.row_number().over(by_symbol).alias("_at"))
    grouped = (
        decided.select("question_id", "_n", shown.alias("key")).filter("key IS NOT NULL")
        .join(broadcast_if_small(members, MAX_KEYS, small or None), "key")
        .select("question_id", (F.col("_n") + F.col("_at")).alias("choice_rank"), "symbol", "name")
    )
    return decisions, first.unionByName(grouped)
