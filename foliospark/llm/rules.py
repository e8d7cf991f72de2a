"""Quality rules whose cutoffs keep the rate of false rejections under a proven bound.

Every rule is a whole number for each document, larger being worse. Among the n good
documents of a stratum, a cutoff at the (k + 1)-th largest number rejects at most k of them,
and the chance that such a cutoff rejects more than a share ``a`` of all good documents is
exactly P(Binomial(n, a) <= k). The cutoff takes the largest k for which that is at most
``DELTA`` divided by the number of rules and strata (Bonferroni), with ``a`` the stratum's
allowance divided among the rules; so with probability 1 - DELTA no stratum loses more than
``ALPHA`` of its good documents. A stratum with too few labels gets no cutoffs.

Everything here is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.session import stored

#: Share of a stratum's good documents that all rules together may reject.
ALPHA = 0.05
#: Chance that the bound fails in some stratum.
DELTA = 0.1

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Rules over the base counts; whole numbers, larger is worse. Also valid SQL elsewhere.
RULES = {
    "symbols": "10000 * n_symbols DIV greatest(word_chars, 1)",
    "duplicate_lines": "10000 * n_dup_lines DIV greatest(n_words, 1)",
    "repeated_words": "10000 * n_repeat_words DIV greatest(n_words, 1)",
    "long_words": "100 * word_chars DIV greatest(n_words, 1)",
    "short_words": "-(100 * word_chars DIV greatest(n_words, 1))",
}


def base_counts(docs: DataFrame) -> DataFrame:
    """The table with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long);
    a null text has no words. Windows are told apart by 64-bit hashes of their words."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1),
                     lambda x: F.translate(x, BLANKS, "") != "")
    out = docs.withColumns({
        "_words": F.filter(F.split(text, "[ \\x09-\\x0D]+", -1), lambda x: x != ""),
        "_lines": lines,
        "word_chars": F.char_length(F.translate(text, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.char_length(text)
                      - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint")})
    out = out.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "_grams": F.when(F.size("_words") >= 3, F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))})
    # Most texts repeat nothing; the others sort their windows by hash and place.
    out = out.withColumn("_sorted", F.when(
        F.size(F.array_distinct("_grams")) < F.size("_grams"),
        F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_twice", F.sort_array(F.filter(F.transform(
        "_sorted", lambda s, j: F.when(
            (F.get("_sorted", j - 1).h == s.h) | (F.get("_sorted", j + 1).h == s.h), s.i)),
        F.isnotnull)))
    covered = F.aggregate(
        F.transform("_twice", lambda p, j: F.least(
            F.lit(3), F.coalesce(F.get("_twice", j + 1) - p, F.lit(3)))),
        F.lit(0), lambda total, n: total + n)
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")) \
        .drop("_words", "_lines", "_grams", "_sorted", "_twice")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def largest_count(n: Column, share: float, chance: Column) -> Column:
    """The largest k with P(Binomial(n, share) <= k) at most ``chance``, -1 if there is none.
    Terms follow from one another in logarithms; k is never above the mean."""
    odds = math.log(share / (1 - share))
    begin = F.struct((n * math.log(1 - share)).alias("term"), F.lit(0.0).alias("total"),
                     F.lit(-1).cast("bigint").alias("k"))

    def step(s: Column, j: Column) -> Column:
        total = s.total + F.exp(s.term)
        return F.struct((s.term + F.log((n - j) / (j + 1)) + odds).alias("term"),
                        total.alias("total"),
                        F.when(total <= chance, j).otherwise(s.k).alias("k"))

    # Up to the mean j is below n, so the logarithm is defined.
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"),
                                  F.least(F.floor(n * share), n - 1)), begin, step).k


def cutoffs(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff): the largest allowed number of each rule, from the numbers of
    good documents (stratum and one column for each rule).

    Only distinct numbers are sorted, with their counts. Strata without any cutoff are left
    out, and so are rules whose cutoff nothing can exceed.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"))
                                for r in RULES]))
    bins = good.select("stratum", pairs.alias("p")).select("stratum", "p.rule", "p.value") \
        .groupBy("stratum", "rule", "value").agg(F.count("*").alias("n"))
    sizes = good.groupBy("stratum").agg(F.count("*").alias("good"))
    strata = sizes.agg(F.count("*").alias("strata"))
    share = alpha / len(RULES)
    allowed = sizes.crossJoin(F.broadcast(strata)).select("stratum", largest_count(
        F.col("good"), share, F.lit(delta) / (len(RULES) * F.col("strata"))).alias("k"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    return bins.withColumn("upto", F.sum("n").over(above)).join(allowed, "stratum") \
        .filter("k >= 0 AND upto > k").groupBy("stratum", "rule") \
        .agg(F.max("value").alias("cutoff"))


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA,
             delta: float = DELTA) -> DataFrame:
    """Base counts, base_failed and kept of every document; strata are languages.

    Good documents are those labelled quality 1 (in all their labels) that pass the base
    rules. A null lang is a stratum; rows may share a doc_id; labels without a document, or
    without a quality, are left out. Without labels only the base rules reject.
    """
    measured = stored(base_counts(docs.select("doc_id", "text", "lang")).select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "n_words", "word_chars",
        "n_symbols", "n_dup_lines", "n_repeat_words").withColumns(
        {r: F.expr(e) for r, e in RULES.items()}).withColumn("base_failed", base_failed()),
        "measured")
    marked = labels.filter("quality IS NOT NULL").groupBy("doc_id") \
        .agg(F.min("quality").alias("quality")).filter("quality = 1").select("doc_id")
    good = measured.filter("NOT base_failed").join(marked, "doc_id", "left_semi")
    limits = cutoffs(good, alpha, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])
    passes = ~F.col("base_failed")
    for r in RULES:
        passes &= F.coalesce(F.col(r) <= F.col(f"max_{r}"), F.lit(True))
    return measured.join(limits, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", passes.alias("kept"))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: NOT regexp_full_match(x, '[ \\x09-\\x0D]*')) AS lines
  FROM documents),
grams AS (
  SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    AS g FROM words),
places AS (
  SELECT doc_id, i, g[i] AS gram FROM grams, unnest(range(1, len(g) + 1)) AS r(i)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM places)
  WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS s(k) GROUP BY doc_id),
counts AS (
  SELECT g.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
    length(regexp_replace(t, '[ \\x09-\\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words
  FROM grams g LEFT JOIN repeated r ON r.doc_id = g.doc_id),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
{rules}
  FROM counts),
good AS (
  SELECT * FROM measured WHERE NOT base_failed AND doc_id IN (
    SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
sizes AS (SELECT stratum, count(*) AS n FROM good GROUP BY stratum),
tails AS (
  SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
      + k * ln({share}) + (n - k) * ln(1 - {share})))
    OVER (PARTITION BY stratum ORDER BY k) AS tail
  FROM sizes, range(0, 1000000) AS j(k) WHERE k <= n * {share} AND k < n),
allowed AS (
  SELECT stratum, max(k) AS k FROM tails
  WHERE tail <= {delta} / ({m} * (SELECT count(*) FROM sizes)) GROUP BY stratum),
numbers AS (
{numbers}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY value DESC) AS place
  FROM numbers),
cutoffs AS (
  SELECT r.stratum, rule, value AS cutoff FROM ranked r JOIN allowed a ON a.stratum = r.stratum
  WHERE place = k + 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (
    SELECT 1 FROM cutoffs c WHERE c.stratum = m.stratum AND cutoff < CASE rule
{cases} END) AS kept
FROM measured m
""".format(
    rules=",\n".join(f"    {e.replace('DIV', '//')} AS {r}" for r, e in RULES.items()),
    numbers="\n  UNION ALL ".join(f"SELECT stratum, '{r}' AS rule, {r} AS value FROM good"
                                  for r in RULES),
    cases="\n".join(f"      WHEN '{r}' THEN m.{r}" for r in RULES),
    share=ALPHA / len(RULES), delta=DELTA, m=len(RULES))
