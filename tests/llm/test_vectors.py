"""Whitening components and hard negatives against plain versions."""

import random

import numpy as np
import pytest
from foliospark.llm import hardneg, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def whitened(spark, rows, schema=VECTORS, **options):
    return whitening.whiten(spark.createDataFrame(rows, schema).repartition(3), **options).toPandas()


def plain_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    a = x - s / n
    v = a.T @ a / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    far = [sum((n * int(p) - int(q)) ** 2 for p, q in zip(row, s)) for row in x]
    return a @ w / np.sqrt(e), e / np.trace(v), far


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(12, 12)) * np.geomspace(1, 1e-2, 12)
    vectors = [v.tolist() for v in (rng.normal(size=(400, 12)) @ mixing + 3).astype(np.float32)]
    vectors += vectors[:30]                                       # repeated rows count as rows
    odd = [(900, None, 1), (901, [], 1), (902, [None] + [0.0] * 11, 1),
           (903, [float("nan")] + [0.0] * 11, 1), (904, [float("inf")] + [0.0] * 11, 1),
           (905, [1.0, 2.0], 1)]
    rows = [(i if i % 50 else None, v, None) for i, v in enumerate(vectors)] + odd
    random.Random(1).shuffle(rows)
    got = whitened(spark, rows)
    want, explained, far = plain_whitening(vectors)
    kept = {i: n for n, i in enumerate(range(len(vectors))) if i % 50}
    assert len(got) == 8 * len(vectors) and set(got.n) == {len(vectors)}
    assert got.vec_id.isna().sum() == 8 * (len(vectors) - len(kept))
    table = got.dropna(subset=["vec_id"]).pivot(index="vec_id", columns="component", values="whitened")
    mine = table.loc[list(kept)].to_numpy()
    want = want[list(kept.values())]
    assert np.abs(mine - want * np.sign((mine * want).sum(axis=0))).max() < 1e-9
    first = got[got.component == 1].dropna(subset=["vec_id"]).set_index("vec_id")
    assert first.loc[list(kept)].deviation.tolist() == [far[i] for i in kept.values()]
    for c, share in enumerate(explained):
        assert np.allclose(got[got.component == c + 1].explained, share, rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_whitening_of_dependent_and_tiny_columns(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-300, 300, size=(200, 3)) / 1024
    # a copied column, a constant one, and one that moves by single steps beside large ones
    wide = np.column_stack([base * 900, base[:, 0] * 900, np.ones(200), rng.integers(0, 2, 200) / 1024])
    got = whitened(spark, [(i, v.tolist(), 0) for i, v in enumerate(wide)])
    want, explained, _ = plain_whitening(wide, 4)
    assert set(got.component) == {1, 2, 3, 4}                     # the rank
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(table - want * np.sign((table * want).sum(axis=0))).max() < 1e-5
    assert np.allclose(sorted(set(got.explained), reverse=True), explained, rtol=1e-6)
    assert got.identity_error[0] < 1e-4


def test_whitening_without_variance_or_rows(spark):
    same = [(i, [0.5, 0.25], 0) for i in range(5)]
    empty = whitened(spark, same)
    assert len(empty) == 0 and "identity_error" in empty.columns
    assert len(whitened(spark, same[:1])) == 0 and len(whitened(spark, [], VECTORS)) == 0
    assert len(whitened(spark, [(1, None, 0), (2, [], 0)])) == 0
    # more dimensions than rows, and columns whose names the result has too
    few = [(i, [float(j == i) for j in range(6)], "x", 1.0) for i in range(3)]
    got = whitened(spark, few, "vec_id int, embedding array<double>, component string, n double")
    assert set(got.component) == {1, 2} and set(got.n) == {3}


def test_whitening_applies_a_fit_to_other_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(50, 4)))]
    df = spark.createDataFrame(rows, VECTORS)
    model = whitening.fit(df)
    part = whitening.whiten(df.filter("vec_id < 3"), model=model).toPandas()
    whole = whitening.whiten(df).toPandas()
    whole = whole[whole.vec_id < 3]
    assert np.allclose(part.sort_values(["vec_id", "component"]).whitened.abs(),
                       whole.sort_values(["vec_id", "component"]).whitened.abs())


def test_deviation_beyond_a_long_is_null():
    x = np.array([[1 << 39], [5]], np.int64)
    assert whitening.deviations(x, 2, np.array([(1 << 39) + 5], np.int64)) == [
        None if (2 * v - (1 << 39) - 5) ** 2 >= 1 << 63 else (2 * v - (1 << 39) - 5) ** 2
        for v in (1 << 39, 5)]


def plain_negatives(rows, least=50, most=95):
    key = lambda i: (i is None, i)
    sound = [(i, label, x) for i, label, x in rows
             if label is not None and x is not None and None not in x]
    anchors = {(i, label, tuple(x)) for i, label, x in sound if i is not None and i % 50 == 0}
    out = []
    for i, label, x in anchors:
        score = lambda y: sum(a * b for a, b in zip(x, y))
        good = sorted(((-score(y), key(j), j) for j, other, y in sound if other == label and j != i),
                      key=lambda r: r[:2])[:5]
        bad = sorted(((-score(y), key(j), j) for j, other, y in sound if other != label),
                     key=lambda r: r[:2])
        for p, _, positive in good:
            fits = [r for r in bad if least * -p <= 100 * -r[0] <= most * -p][:3]
            out += [(i, positive, rank, r[2], -p, -r[0]) for rank, r in enumerate(fits, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, schema="vec_id bigint, label int, x array<bigint>"):
    df = spark.createDataFrame(rows, schema).repartition(4)
    return sorted((tuple(r) for r in hardneg.mine(df).collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_hard_negatives_against_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(hardneg, "CLUSTER", 4)
    monkeypatch.setattr(hardneg, "GROUP", 3)            # groups within clusters
    monkeypatch.setattr(hardneg, "ROUND_BYTES", 2000)    # several rounds
    monkeypatch.setattr(hardneg, "SLAB", 4)
    monkeypatch.setattr(hardneg, "BLOCK", 40)
    rng = random.Random(seed)
    centres = [[rng.randrange(-9, 10) for _ in range(5)] for _ in range(4)]
    rows = []
    for n in range(600):
        c = rng.choice(centres)
        x = [v + rng.randrange(-2, 3) for v in c] if rng.random() < 0.7 else list(c)
        rows.append((n * rng.choice([1, 5]), rng.randrange(3), x))
    rows += [(100, 1, centres[0]), (100, 1, centres[0]), (100, 2, centres[1]), (7, 1, centres[0])] * 2
    rows += [(None, 1, centres[0]), (None, 2, centres[0]), (50, None, centres[0]), (150, 1, None),
             (200, 1, [None, 1, 2, 3, 4]), (250, 1, [0] * 5), (300, 0, [1, 2]), (350, 0, []),
             (400, 1, [3] * 9), (450, 2, [1 << 20, 1, 1, 1, 1]), (451, 2, [1 << 20, 1, 1, 1, 3]),
             (452, 1, [1 << 19, 1, 1, 1, 3])]
    assert mined(spark, rows) == plain_negatives(rows)


def test_no_anchors_and_clashing_names(spark):
    rows = [(1, 0, [1, 2]), (2, 1, [1, 2])]
    assert mined(spark, rows) == [] and mined(spark, []) == []
    df = spark.createDataFrame([(50, [0.5, 0.5], 0, "a", "b"), (51, [0.5, 0.5], 0, "a", "b"),
                                (52, [0.25, 0.5], 1, "a", "b"), (53, [float("nan"), 0.5], 1, "a", "b"),
                                (54, None, 1, "a", "b")],
                               "vec_id bigint, embedding array<float>, label int, rank string, x string")
    got = hardneg.mine(hardneg.labelled(df)).collect()
    assert [tuple(r) for r in got] == [(50, 51, 1, 52, 2 * 128 * 128, 64 * 128 + 128 * 128)]


def test_walks_end_before_the_list():
    """In tight clusters the bound ends the walk; the count of products shows it."""
    import pyarrow as pa
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 100
    label = rng.integers(0, 20, 4000)
    x = np.rint(centres[label] + rng.normal(size=(4000, 16)) * 3).astype(np.int64)
    who = np.flatnonzero(label == 4)[:40]
    floor = np.array([np.sort(x[who] @ x[i])[-5] for i in who])
    lists = lambda v: pa.array([[int(a)] for a in v], pa.list_(pa.int64()))
    table = pa.table({"vec_id": who, "label": label[who], "mark": who, "cluster": np.zeros(40, int),
                      "part": np.zeros(40, int), "x": pa.array(x[who].tolist()),
                      "low": lists([hardneg._NONE] * 40), "high": lists([-hardneg._NONE] * 40),
                      "floor": lists(floor), "floor_id": lists([hardneg._LAST] * 40)})
    walkers = hardneg.Walkers(table, 16, True, 5)
    done = hardneg.walk(walkers, x, label, np.arange(4000))
    assert done < 40 * 4000 / 3
    for at, i in enumerate(who):
        others = np.flatnonzero((label == 4) & (np.arange(4000) != i))
        want = sorted((-int(x[i] @ x[j]), j) for j in others)[:5]
        needs = walkers.needs[0]
        mine = np.flatnonzero(needs.key == at)
        assert sorted((-s, j) for s, j in zip(needs.score[mine], needs.id[mine])) == want
