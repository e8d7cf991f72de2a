"""Mixing sources to target weights."""

import collections
import random

from foliospark.llm import mixing
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n, rng):
    return rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\n", "\x0b"]).join("w%d" % i for i in range(n))


def plain_targets(sizes, weights, budget, epochs=2):
    """The rounds as told: clamp, share the excess again."""
    target = {s: 0.0 for s in sizes}
    free, rest = set(sizes), budget
    while free:
        total = sum(weights[s] for s in free)
        for s in free:
            target[s] = rest * weights[s] / total
        over = {s for s in free if target[s] > epochs * sizes[s]}
        for s in over:
            target[s] = epochs * sizes[s]
            rest -= target[s]
        if not over:
            return target
        free -= over
    return target


def docs_of(seed=1, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", "z", "src2", "src10", None])
        size = rng.choice([0, 1, 3, 20, 50]) if source != "z" else 2
        rows.append((i, words(size, rng) if rng.random() > 0.02 else None, "en", source, 0))
    rows.append((5000, words(4000, rng), "en", "a", 0))
    rows += [(5001, "same text here", "en", "hot", 0)] * 3 + [(None, "x y", None, "B", 0)]
    rows += [(5002, None, None, "nothing", None), (5003, " \n", None, "nothing", None)]
    return rows


def test_targets_and_takes(spark):
    rows = docs_of()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = mixing.mix(df).collect()
    size = lambda t: len((t or "").split())
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    sums = collections.Counter()
    for _, t, _, s, _ in rows:
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = plain_targets(sums, weights, 1.5 * sum(sums.values()))
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.repeats * r.size + r.part
        taken[r.source] += r.taken
    for s in sums:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    other = mixing.mix(df, seed="mix-2").collect()
    assert sorted(map(repr, other)) != sorted(map(repr, got))


def test_texts_of_the_mix(spark):
    rows = [r for r in docs_of(2) if r[0] is not None and r[0] != 5001]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(df)
    taken = {r.doc_id: r.taken for r in mixed.collect()}
    got = collections.Counter()
    copies = collections.defaultdict(list)
    for r in mixing.expand(df, mixed).collect():
        got[r.doc_id] += len(r.text.split())
        copies[r.doc_id].append(r.copy)
    assert dict(got) == {i: n for i, n in taken.items() if n}
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in copies.values())


def test_own_weights_and_a_budget_out_of_reach(spark):
    df = spark.createDataFrame([(1, "a b c d", None, "p", 0), (2, "a b", None, "q", 0),
                                (3, "a", None, "r", 0)], DOCS)
    weights = spark.createDataFrame([("p", 1), ("q", 7)], "source string, weight bigint")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(df, weights, percent=100).collect()}
    assert got == {1: (2.0, 2), 2: (4.0, 4)}                  # r has no weight; q is clamped
    got = {r.doc_id: r.taken for r in mixing.mix(df, percent=900).collect()}
    assert got == {1: 8, 2: 4, 3: 2}


def test_no_rows_no_words_and_clashing_names(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).collect() == []
    df = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, "s", 0)], DOCS)
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2
    df = spark.createDataFrame([(1, "a b", None, "s", 0)], DOCS).withColumns(
        {"size": F.lit("x"), "target": F.lit("y"), "weight": F.lit("z"), "taken": F.lit(None)})
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(2, 3.0, 3)]


def test_hot_source_is_cut_without_being_sorted_in_one_place(spark):
    """Only documents with the cut's digits meet in one window."""
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"),
                                   F.lit("only").alias("source"))
    got = mixing.mix(df).agg(F.sum("taken"), F.max("taken"), F.first("target")).first()
    assert tuple(got) == (90000, 6, 90000.0)
