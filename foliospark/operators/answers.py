"""Jobs over answer logs: folding events, citations, and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import answers as fa

EVENT_SLICE = 512
HIT_K = 5
CONTROL = "REFUSE"
# The candidate thresholds; the last one is the shipped default.
SWEEP = (0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)
OVERLAP_CHARS = 60


def fold_answer_events(events: DataFrame) -> DataFrame:
    """One row per request: sources, concatenated text, refused, error, finished.

    Events are joined up in slices of their sequence numbers first and the slices per
    request after that, so a long stream arrives at its request already combined. The
    last sources, done and error events count.
    """
    parted = events.withColumn("_part", F.floor(F.col("seq") / EVENT_SLICE))

    def joined(order: str, text: Column) -> Column:
        pieces = F.sort_array(F.collect_list(F.when(
            text.isNotNull(), F.struct(F.col(order).alias("at"), text.alias("text")))))
        return F.array_join(F.transform(pieces, lambda p: p["text"]), "")

    def last(value: str, kind: str) -> Column:
        return F.max_by(value, F.when(F.col("type") == kind, F.col("seq")))

    delta = F.when(F.col("type") == "delta", F.col("text"))
    ends = F.col("type").isin("done", "error")
    partial = parted.groupBy("request_id", "_part").agg(
        joined("seq", delta).alias("text"),
        *(F.max(F.when(F.col("type") == t, F.col("seq"))).alias(f"_{t}_at")
          for t in ("sources", "done", "error")),
        last("sources", "sources").alias("sources"),
        last("refused", "done").alias("refused"),
        last("error", "error").alias("error"),
        F.bool_or(ends).alias("finished"),
    )
    return partial.groupBy("request_id").agg(
        F.max_by("sources", "_sources_at").alias("sources"),
        joined("_part", F.col("text")).alias("answer"),
        F.max_by("refused", "_done_at").alias("refused"),
        F.max_by("error", "_error_at").alias("error"),
        F.bool_or("finished").alias("finished"),
    )


def parse_citations(answers: DataFrame) -> DataFrame:
    """(request_id, ord, n): cited numbers in order of appearance, repeats kept."""
    return answers.select(
        "request_id", F.posexplode_outer(fa.cited_numbers(F.col("answer"))).alias("ord", "n")
    ).filter("ord IS NOT NULL").withColumn("ord", F.col("ord") + 1)


def resolve_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """Citations with their source row; a number out of range stays unresolved."""
    listed = sources.withColumnRenamed("rank", "n")
    return citations.join(listed, ["request_id", "n"], "left").withColumn(
        "resolved", F.col("symbol").isNotNull())


def settle_answers(answers: DataFrame) -> DataFrame:
    """Adds verdict, shown and outcome to rows (question, answer, gate_refused, failed)."""
    answer, question = F.col("answer"), F.col("question")
    return (
        answers.withColumn("verdict", fa.verdict_tag(answer))
        .withColumn("shown", fa.shown_answer(answer, question))
        .withColumn("outcome", fa.outcome(F.col("gate_refused"), F.col("failed"), answer, question))
    )


def grounding(answers: DataFrame) -> DataFrame:
    """Adds has_citation, grounded and cited_expected to rows (answer, expect,
    source_symbols), where source_symbols lists the sources in order. Row-local: an
    answer and its sources are small."""
    cited = F.array_distinct(fa.cited_numbers(F.col("answer")))
    size = F.size("source_symbols")

    def in_range(n: Column) -> Column:
        return (n >= 1) & (n <= size)

    return (
        answers.withColumn("_cited", cited)
        .withColumn("has_citation", F.size("_cited") > 0)
        .withColumn("grounded", (F.size("_cited") > 0) & F.forall("_cited", in_range))
        .withColumn("cited_expected", F.exists("_cited", lambda n: in_range(n) & F.coalesce(
            F.get("source_symbols", n - 1) == F.col("expect"), F.lit(False))))
        .drop("_cited")
    )


def hits(expectations: DataFrame, retrieved: DataFrame, k: int = HIT_K) -> DataFrame:
    """(query_id, expect, first_rank, hit) from (query_id, expect) and ranked rows
    (query_id, rank, symbol). Controls have neither."""
    first = (
        retrieved.filter(F.col("rank") <= k).join(expectations, "query_id")
        .filter(F.col("symbol") == F.col("expect"))
        .groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    )
    is_control = F.col("expect") == CONTROL
    return expectations.join(first, "query_id", "left").select(
        "query_id", "expect",
        F.when(~is_control, F.col("first_rank")).alias("first_rank"),
        F.when(~is_control, F.col("first_rank").isNotNull()).alias("hit"),
    )


def verdict(refused: Column, has_citation: Column, grounded: Column, cited_expected: Column,
            expect: Column, error: Column) -> Column:
    passed = has_citation & grounded & cited_expected
    return (
        F.when(F.length(error) > 0, F.lit("ERROR"))
        .when(expect == CONTROL, F.when(refused & ~has_citation, F.lit("PASS"))
              .otherwise(F.lit("FAIL")))
        .when(refused, F.lit("REFUSED"))
        .when(passed, F.lit("PASS"))
        .otherwise(F.lit("FAIL"))
    )


def judge(answers: DataFrame) -> DataFrame:
    """Adds refused_any and verdict to folded answers (answer, refused, error, expect,
    source_symbols): refused by the gate or by the phrase in the text."""
    refused = F.coalesce("refused", F.lit(False)) | F.lower("answer").contains(fa.REFUSAL)
    return grounding(answers).withColumn("refused_any", refused).withColumn(
        "verdict", verdict(F.col("refused_any"), F.col("has_citation"), F.col("grounded"),
                           F.col("cited_expected"), F.col("expect"), F.col("error")))


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("verdict").agg(F.count("*").alias("answers"))


def threshold_sweep(scores: DataFrame, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """Per threshold: answerable questions wrongly refused, whether every control is
    caught, and the answerable score range. One pass over (expect, max_score): each
    threshold is a conditional count, turned into rows after the aggregation."""
    control = F.col("expect") == CONTROL
    score = F.col("max_score")
    aggs = []
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if(~control & (score < t)).alias(f"_false_{i}"))
        aggs.append(F.coalesce(F.bool_and(F.when(control, score < t)), F.lit(True))
                    .alias(f"_caught_{i}"))
    totals = scores.agg(
        *aggs, F.min(F.when(~control, score)).alias("min_score"),
        F.max(F.when(~control, score)).alias("max_score"))
    rows = F.array(*(
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_false_{i}").alias("false_refusals"),
                 F.col(f"_caught_{i}").alias("controls_caught"))
        for i, t in enumerate(thresholds)))
    return totals.select("min_score", "max_score", F.inline(rows))


def compare_retrievals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, overlap, digits_a, digits_b) for two retrievals with symbol, page and
    content: rows of b whose key is in a, and rows that mention a number. The key is
    not unique, so rows of b are counted, not keys."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("query_id", "symbol", "page", F.left("content", F.lit(OVERLAP_CHARS))
                         .alias("head"), F.col("content").rlike("[0-9]").alias("digit"))

    # Null-safe page: a missing page is a value of the key.
    page = F.coalesce(F.col("page"), F.lit(-1))
    ka, kb = keyed(a).withColumn("page", page), keyed(b).withColumn("page", page)
    shared = ka.select("query_id", "symbol", "page", "head").distinct().withColumn(
        "_in_a", F.lit(1))
    side_a = ka.groupBy("query_id").agg(F.count_if("digit").alias("digits_a"))
    side_b = kb.join(shared, ["query_id", "symbol", "page", "head"], "left").groupBy(
        "query_id").agg(F.count("_in_a").alias("overlap"), F.count_if("digit").alias("digits_b"))
    return side_a.join(side_b, "query_id", "full_outer").na.fill(0).select(
        "query_id", "overlap", "digits_a", "digits_b")


def stage_latency(log: DataFrame) -> DataFrame:
    """Per outcome: requests, mean and 95th percentile of each stage in ms."""
    stages = ("embed_ms", "retrieve_ms", "generate_ms", "total_ms")
    return log.groupBy("outcome").agg(
        F.count("*").alias("requests"),
        *(F.round(F.avg(s), 3).alias(f"avg_{s}") for s in stages),
        *(F.percentile_approx(s, 0.95, 10_000).alias(f"p95_{s}") for s in stages),
    )
