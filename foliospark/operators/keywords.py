"""Shaping a question into the keyword channel's search text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import word_set
from foliospark.session import broadcast_if_small

# Question words, verbs of saying and generic time words.
QUESTION_STOP_WORDS = (
    "the", "a", "an", "of", "for", "on", "in", "to", "and", "or", "with", "at", "by", "from", "as",
    "into", "over", "under", "about", "regarding", "per", "vs", "versus", "during", "between",
    "after", "before", "since", "while", "within", "across", "through", "towards", "against",
    "including", "such", "also", "other", "each", "both", "than", "then", "but", "whether", "not",
    "only", "just", "still", "yet", "very", "is", "are", "was", "were", "be", "been", "being", "do",
    "does", "did", "has", "have", "had", "will", "would", "can", "could", "should", "may", "might",
    "what", "which", "who", "whom", "how", "why", "when", "where", "whats", "say", "said", "says",
    "tell", "told", "mention", "mentioned", "comment", "commented", "comments", "discuss",
    "discussed", "describe", "described", "note", "noted", "their", "its", "they", "them", "this",
    "that", "these", "those", "there", "any", "all", "some", "much", "many", "more", "most", "key",
    "main", "recent", "latest", "last", "next", "current", "year", "years", "quarter", "quarters",
    "quarterly", "fiscal", "annual", "management", "company", "companies", "limited", "ltd",
)

# Terms the filings use for one another.
SYNONYMS = {
    "capital expenditure": ["capex"],
    "capex": ["capital expenditure"],
    "net interest margin": ["nim"],
    "nim": ["net interest margin"],
    "profit after tax": ["pat", "net profit"],
    "net profit": ["profit after tax", "pat"],
    "earnings per share": ["eps"],
    "eps": ["earnings per share"],
    "total contract value": ["tcv", "deal wins"],
    "deal wins": ["tcv", "large deals"],
    "tcv": ["total contract value", "deal wins"],
    "non performing assets": ["npa", "gross npa"],
    "npa": ["non performing assets"],
    "return on equity": ["roe"],
    "roe": ["return on equity"],
    "free cash flow": ["fcf"],
}

MIN_TOKEN_CHARS = 3
MAX_COMPANIES = 100_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def company_drop_terms(symbol: Column, name: Column) -> Column:
    """The company's own words: its symbol and the words of its name."""
    own = F.concat(F.array(F.lower(symbol)), _words(name))
    return F.filter(own, lambda w: ~F.array_contains(word_set(QUESTION_STOP_WORDS), w))


def shape_keyword_query(question: Column, drop_terms: Column) -> Column:
    """OR of content terms and their synonyms, phrases quoted, in first-seen order.
    Empty when nothing is left."""
    asked = F.regexp_replace(F.lower(question), r"[’']s(?![A-Za-z0-9_])", "")
    none = F.array().cast("array<string>")

    def listed(words: list[str]) -> Column:
        return F.array(*(F.lit(w) for w in words))

    phrases = [
        F.when(asked.contains(key), listed([key, *others])).otherwise(none)
        for key, others in SYNONYMS.items() if " " in key
    ]
    related = F.create_map(*(
        part for key, others in SYNONYMS.items() if " " not in key
        for part in (F.lit(key), listed(others))
    ))
    content = F.filter(
        _words(asked),
        lambda w: (F.length(w) >= MIN_TOKEN_CHARS)
        & ~F.array_contains(word_set(QUESTION_STOP_WORDS), w)
        & ~F.array_contains(F.coalesce(drop_terms, none), w),
    )
    expanded = F.flatten(F.transform(
        content, lambda w: F.concat(F.array(w), F.coalesce(F.try_element_at(related, w), none))))
    ordered = F.array_distinct(F.concat(*phrases, expanded))
    quoted = F.transform(ordered, lambda t: F.when(
        t.contains(" "), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))
    return F.array_join(quoted, " OR ")


def shape_questions(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds ``keyword_query``. A question scoped to a company by filter_symbol drops
    that company's own words."""
    own = companies.select(
        F.col("symbol").alias("filter_symbol"),
        company_drop_terms(F.col("symbol"), F.col("name")).alias("_drop"),
    )
    if "filter_symbol" not in questions.columns:
        questions = questions.withColumn("filter_symbol", F.lit(None).cast("string"))
    return (
        questions.join(broadcast_if_small(own, MAX_COMPANIES), "filter_symbol", "left")
        .withColumn("keyword_query", shape_keyword_query(F.col("question"), F.col("_drop")))
        .drop("_drop")
    )
