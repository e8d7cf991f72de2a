"""Candidate pairs against all pairs."""

import random

import pytest
from foliospark.operators import entities, matching
from pyspark.sql import functions as F


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def made_up(rng, n, longest=14, letters="abcé&"):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.fixture(scope="module")
def both(spark):
    rng = random.Random(4)
    texts = made_up(rng, 150) + ["abcabcabcabcabcabcabcabcabcab", "é" * 30]
    queries = sorted({*made_up(rng, 60), *texts[:20], "a", "ab", "zz", "aé&", "abcabcabcabcabcabcabcabcabca"}
                     | {t[1:] for t in texts[20:40] if len(t) > 1} | {t + "b" for t in texts[40:60]})
    return queries, sorted(set(texts))


def pairs(found):
    return {tuple(r) for r in found.collect()}


def frames(spark, both):
    return (spark.createDataFrame([(q,) for q in both[0]], "query string"),
            spark.createDataFrame([(t,) for t in both[1]], "text string"))


def test_within(spark, both):
    want = {(q, t) for q in both[0] for t in both[1] if q in t}
    assert pairs(matching.within(*frames(spark, both))) == want and want


@pytest.mark.parametrize("ratio,gap", [(0.4, None), (0.3, 2), (0.5, None)])
def test_similar(spark, both, ratio, gap):
    want = set()
    for q in both[0]:
        for t in both[1]:
            d = edits(q, t)
            if 1 <= d <= ratio * max(len(q), len(t)) + 1e-9 and (
                    gap is None or abs(len(q) - len(t)) <= gap):
                want.add((q, t))
    assert pairs(matching.similar(*frames(spark, both), ratio, gap)) == want and want


def test_in_order(spark, both):
    def runs_through(q, t):
        rest = iter(t)
        return all(c in rest for c in q)
    want = {(q, t) for q in both[0] for t in both[1] if len(q) >= 3 and runs_through(q, t)}
    assert pairs(matching.in_order(*frames(spark, both))) == want and want


def test_no_queries_or_texts(spark, both):
    asked, texts = frames(spark, both)
    for f in (matching.within, matching.in_order, lambda q, t: matching.similar(q, t, 0.4)):
        assert f(asked.limit(0), texts).count() == 0 and f(asked, texts.limit(0)).count() == 0


def test_scores_of_all_pairs_and_few_candidates(spark):
    """Candidates lose no pair with a score, and are few among long names."""
    rng = random.Random(8)
    syllable = ["ka", "ri", "mo", "tel", "san", "vor", "qui", "lex", "pra", "den"]
    word = lambda n: "".join(rng.choice(syllable) for _ in range(n))
    rows = [(word(rng.randint(2, 4)).upper(), f"{word(3).title()} {word(2).title()}-{word(2)} Ltd")
            for _ in range(300)] + [("NULLNAME", None), (None, "Null Symbol"), ("A&B", "A & B")]
    rows += rows[:3]
    asked = [word(rng.randint(1, 4)) for _ in range(40)] + ["ltd", "a&b", "null", "nulname", " ", None]
    asked += [s.lower()[:-1] + "x" for s, _ in rows[:20]] + [s.lower()[::2] for s, _ in rows[:20]]
    names = spark.createDataFrame(rows, "symbol string, name string")
    queries = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {(r.query, r.symbol, r.name): r.score
           for r in entities.score_entities(queries, names, None).collect()}
    low = F.lower("name")
    distinct = queries.filter("trim(query) <> ''").distinct()
    every = distinct.join(names.distinct(), F.lit(True)).withColumn("score", entities.match_score(
        F.col("query"), F.lower("symbol"), low, entities._name_words(low)))
    want = {(r.query, r.symbol, r.name): r.score for r in every.filter("score > 0").collect()}
    assert got == want and len(want) > 300
    met = entities.entity_candidates(distinct, names).count()
    assert len(want) <= met < every.count() / 4
