"""Column helpers over finished answer texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip

# The refusal phrase, the citation form and the verdict tag.
REFUSAL = "not found in the covered filings"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
CITATION_OPEN = r"\[\d+"
VERDICT_TAG = r"(?i)^\s*(?:\*\*)?(ANSWER:|NOT_FOUND)(?:\*\*)?[ \t]*:?[ \t]*\r?\n?"
ECHO_SEPARATORS = r"^[\s:—–-]+"


def cited_numbers(answer: Column) -> Column:
    """``[3]`` and ``[3, 5]`` markers as an array of ints, repeats kept, in order."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.flatten(
        F.transform(groups, lambda g: F.transform(
            F.split(g, ","), lambda n: F.trim(F.regexp_replace(n, r"\s+", "")).cast("int")))
    )


def verdict_tag(answer: Column) -> Column:
    """'ANSWER:', 'NOT_FOUND' or an empty string."""
    return F.upper(F.regexp_extract(answer, VERDICT_TAG, 1))


def without_echo(text: Column, question: Column) -> Column:
    """Text without a leading repetition of the question."""
    asked = F.lower(strip(question))
    lead = F.regexp_replace(text, r"^\s+", "")
    rest = lead.substr(F.length(asked) + 1, F.length(lead))
    return F.when(
        (F.length(asked) > 0) & F.startswith(F.lower(lead), asked),
        F.regexp_replace(rest, ECHO_SEPARATORS, ""),
    ).otherwise(text)


def is_refusal(answer: Column, question: Column) -> Column:
    tag = verdict_tag(answer)
    body = without_echo(answer, question)
    return (tag == "NOT_FOUND") | ((tag == "") & F.lower(body).contains(REFUSAL))


def shown_answer(answer: Column, question: Column) -> Column:
    """What the reader sees: the phrase alone for a refusal, else the tagless body."""
    untagged = F.regexp_replace(answer, VERDICT_TAG, "")
    body = F.regexp_replace(without_echo(untagged, question), r"^\s+", "")
    return F.when(is_refusal(answer, question), F.lit(REFUSAL)).otherwise(body)


def outcome(gate_refused: Column, failed: Column, answer: Column, question: Column) -> Column:
    """How a finished request ended."""
    produced = F.length(F.coalesce(answer, F.lit(""))) > 0
    return (
        F.when(gate_refused, F.lit("refused_threshold"))
        .when(failed & ~produced, F.lit("extractive"))
        .when(failed, F.lit("interrupted"))
        .when(is_refusal(answer, question) | ~answer.rlike(CITATION_OPEN), F.lit("refused_model"))
        .otherwise(F.lit("answered"))
    )
