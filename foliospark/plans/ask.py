"""Answering a table of questions, end to end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.answers import REFUSAL
from foliospark.functions.guard import REQUESTS_PER_DAY, rejection
from foliospark.operators.admission import admit_requests
from foliospark.operators.answers import settle_answers
from foliospark.operators.embedding import run_generator
from foliospark.operators.entities import route_questions
from foliospark.operators.hybrid import (
    ASK_TOP_K, GATE_THRESHOLD, build_contexts, build_prompts, confidence_gate,
    extractive_answers, retrieve_for_questions, shown_sources,
)
from foliospark.session import stored


def gate_questions(questions: DataFrame, entities: DataFrame, limit: int = REQUESTS_PER_DAY,
                   ) -> tuple[DataFrame, DataFrame]:
    """(questions, choices): what becomes of each question (query_id, question, ip, ts, and
    optionally k and filter_* columns) before anything costly is done for it.

    In turn: input checks ('rejected', status 400 or 413), the caller's daily limit over the
    questions that passed them ('over_limit', 429), and routing: a question that could mean
    several companies is handed back ('choose', with its rows in ``choices``), one that names a
    single company is narrowed to it by ``filter_symbol``. A null outcome is open.
    """
    for name, kind in (("filter_symbol", "string"), ("filter_doc_type", "string"), ("k", "int")):
        if name not in questions.columns:
            questions = questions.withColumn(name, F.lit(None).cast(kind))
    check = rejection(F.col("question"), F.col("filter_doc_type"), F.col("k"))
    checked = stored(questions.withColumn("_check", check), "asked")
    passed = checked.filter("_check IS NULL")
    admitted = admit_requests(passed.select("ip", "ts", F.col("query_id").alias("id")), limit)
    admitted = stored(admitted.select(F.col("id").alias("query_id"), "allowed"), "admitted")
    let_in = passed.join(admitted.filter("allowed"), "query_id").select(
        F.col("query_id").alias("question_id"), "question")
    decisions, choices = route_questions(let_in, entities)
    single = choices.filter("choice_rank = 1").select("question_id", F.col("symbol").alias("_symbol"))
    routed = decisions.join(single, "question_id", "left").select(
        F.col("question_id").alias("query_id"), "kind", F.col("reason").alias("_why"),
        F.when(F.col("kind") == "scope", F.col("_symbol")).alias("_symbol"))
    gated = checked.join(admitted, "query_id", "left").join(routed, "query_id", "left")
    outcome = (
        F.when(F.col("_check").isNotNull(), F.lit("rejected"))
        .when(~F.col("allowed"), F.lit("over_limit")).when(F.col("kind") == "choose", F.lit("choose"))
    )
    status = F.coalesce("_check.status", F.when(~F.col("allowed"), F.lit(429)), F.lit(200))
    gated = gated.withColumns({
        "status": status, "outcome": outcome, "reason": F.coalesce("_check.reason", "_why"),
        "filter_symbol": F.coalesce("filter_symbol", "_symbol")})
    return gated.drop("_check", "allowed", "kind", "_why", "_symbol"), choices


def ask(questions: DataFrame, chunks: DataFrame, companies: DataFrame, entities: DataFrame,
        generate: Callable[[str, str | None], str] | None = None,
        fallback: Callable[[str, str | None], str] | None = None,
        postings: DataFrame | None = None, limit: int = REQUESTS_PER_DAY, k: int = ASK_TOP_K,
        threshold: float = GATE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, sources, choices). Every question gets one outcome row (query_id, status,
    outcome, reason, answer); only those that pass all gates reach retrieval and the
    generator. Questions also have an embedding."""
    gated, choices = gate_questions(questions, entities, limit)
    gated = stored(gated, "gated")
    open_ = gated.filter("outcome IS NULL").drop("status", "outcome", "reason", "ip", "ts")
    answers, sources = answer_questions(open_, chunks, companies, generate, fallback, postings, k,
                                        threshold)
    answered = answers.select("query_id", F.lit(200).alias("status"), "outcome",
                              F.lit(None).cast("string").alias("reason"), "answer")
    closed = gated.filter("outcome IS NOT NULL").select(
        "query_id", "status", "outcome", "reason", F.lit(None).cast("string").alias("answer"))
    return closed.unionByName(answered), sources, choices


def answer_questions(questions: DataFrame, chunks: DataFrame, companies: DataFrame,
                     generate: Callable[[str, str | None], str] | None = None,
                     fallback: Callable[[str, str | None], str] | None = None,
                     postings: DataFrame | None = None, k: int = ASK_TOP_K,
                     threshold: float = GATE_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(answers, sources). Refused questions never reach the generator; a question whose
    generators all fail gets the extractive answer."""
    sources, summary = retrieve_for_questions(questions, chunks, companies, postings, k)
    gated = confidence_gate(summary, threshold)
    shown = shown_sources(sources, gated)
    prompts = build_prompts(build_contexts(shown), gated)
    if generate is None:
        replies = prompts.select("query_id", F.lit(None).cast("string").alias("answer"),
                                 F.lit(True).alias("failed"))
    else:
        replies = run_generator(prompts, generate, fallback).select("query_id", "answer", "failed")
    settled = settle_answers(
        gated.join(replies, "query_id", "left")
        .withColumn("failed", F.coalesce("failed", F.lit(False)))
        .withColumnRenamed("refused", "gate_refused")
    )
    extract = extractive_answers(shown).withColumnRenamed("answer", "_extract")
    text = (
        F.when(F.col("outcome") == "refused_threshold", F.lit(REFUSAL))
        .when(F.col("outcome") == "extractive", F.col("_extract")).otherwise(F.col("shown"))
    )
    answers = settled.join(extract, "query_id", "left").select(
        "query_id", "question", "keyword_query", "max_score", "n_sources", "shown_sources",
        "outcome", text.alias("answer"))
    return answers, shown
