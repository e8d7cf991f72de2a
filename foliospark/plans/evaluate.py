"""Scoring an answer log against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.operators.answers import (
    fold_answer_events, hits, judge, threshold_sweep, verdict_counts,
)


def evaluate(expectations: DataFrame, retrieved: DataFrame, scores: DataFrame,
             events: DataFrame) -> dict[str, DataFrame]:
    """``expectations``: query_id, expect; ``retrieved``: query_id, rank, symbol;
    ``scores``: query_id, max_score; ``events``: answer events with request_id = query_id.
    """
    folded = fold_answer_events(events).withColumnRenamed("request_id", "query_id")
    answered = expectations.join(folded, "query_id").withColumn(
        "source_symbols", F.coalesce(F.transform("sources", lambda s: s["symbol"]),
                                     F.array().cast("array<string>")))
    judged = judge(answered)
    return {
        "hits": hits(expectations, retrieved),
        "judged": judged,
        "verdicts": verdict_counts(judged),
        "sweep": threshold_sweep(expectations.join(scores, "query_id")),
    }
