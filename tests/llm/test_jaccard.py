"""Similar sets and their components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import jaccard
from foliospark.llm.components import components
from foliospark.llm.texts import texts_of
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([tuple(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n
                     else [tuple(w)] if w else [])


def brute(rows, n=4, percent=85):
    sets = [shingles(t, n) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                part[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i), d) if s else d)
                   for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def made_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 8, 9, 12, 30, 90]))]
        if base % 3 == 0:
            text += passage.split()
        for _ in range(rng.choice([1, 1, 2, 6])):     # chains of small edits
            text = list(text)
            for _ in range(rng.choice([0, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 2, " ".join(text).upper() if rng.random() < .3
                         else "\t".join(text)))
    return rows + [(1, None), (3, ""), (5, " \n"), (7, "lone"), (9, "LONE"), (7, "lone"),
                   (11, "a b c d e f"), (11, "g h i j k l"), (13, "g h i j k l"), (None, "lone")]


@pytest.mark.parametrize("seed,twos,group", [(1, None, 1 << 24), (2, 1.0, 2000), (3, 0.0, 500)])
def test_components_are_those_of_all_pairs(spark, seed, twos, group, monkeypatch):
    if twos is not None:                              # the dearest and the cheapest allocation
        monkeypatch.setattr(jaccard, "SHARED_SETS", twos * 1000)
    rows = made_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard.ngram_components(docs, group_bytes=group).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_large_keys_are_settled_in_rounds_over_blocks(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(40):                               # near copies at and about the bound
        text = list(base)
        for k in range(rng.choice([1, 2, 3])):
            text[rng.randrange(10 * (i % 7), 10 * (i % 7) + 10)] = f"x{i}.{k}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.ngram_components(docs, block=6).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_near_copies_name_fewer_pairs_than_sets_and_keys_have(spark, monkeypatch):
    """A group in which most pairs are similar gives out forests, not each set's many partners."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        text = list(base)
        for k in range(rng.choice([1, 1, 2, 2, 2, 3])):
            text[rng.randrange(150)] = f"x{i}.{k}"
        rows.append((i, " ".join(text)))
    named = []

    def counted(df, name):
        out = stored(df, name)
        if name == "pairs":
            named.append(out.filter("b IS NOT NULL").distinct().count())
        return out

    stored = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", counted)
    got = jaccard.ngram_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert named[0] < 5 * len(rows)


@pytest.mark.parametrize("each", [jaccard.SHORT, jaccard.SKETCH])
def test_later_rounds_get_the_sets_of_open_pairs_only(each):
    """Of a key, the next round gets the sets of the open pairs that were not given out."""
    rng = random.Random(5)
    base, some = [f"w{i}" for i in range(150)], []
    for i in range(12):                               # near copies, all pairs of which are open
        text = list(base)
        text[rng.randrange(150)] = f"x{i}"
        some.append(" ".join(text))
    some += [" ".join(f"y{i}.{k}" for k in range(150)) for i in range(30)]
    element, owner = jaccard.shingle_sets(texts_of(pa.array(some)), 4)
    size = np.bincount(owner, minlength=len(some))
    sketch = jaccard.sketches(element, owner, size, 85, each).to_pylist()
    members = [{"node": i, "part": i, "n": int(size[i]), "sketch": sketch[i]} for i in range(len(some))]
    batch = pa.record_batch({"key": pa.array([7]), "members": pa.array([members])})
    [out] = jaccard._across(85, 1)([batch])
    named = {(r["a"], r["b"]) for r in out.to_pylist() if r["b"] is not None}
    [left] = [r["sets"] for r in out.to_pylist() if r["b"] is None]
    assert len(named) == 11 and max(left) < 12
    assert all((i, j) in named or {i, j} <= set(left) for i in range(12) for j in range(i + 1, 12))


@pytest.mark.parametrize("seed", range(3))
def test_forests_cover_components_by_first_edges(seed):
    """Layers are minimum spanning forests of what is left, also when edges come in parts."""
    rng = np.random.default_rng(seed)
    which = rng.integers(0, 25, 40)
    edges = np.unique(np.column_stack([rng.integers(0, 6, 300), rng.integers(0, 40, (300, 2))]), axis=0)
    edges = edges[which[edges[:, 1]] != which[edges[:, 2]]].astype(np.int32)
    left, want = list(map(tuple, edges)), []
    for _ in range(3):
        part, took = list(range(25)), []

        def find(x):
            while part[x] != x:
                x = part[x]
            return x

        for e in sorted(left):
            x, y = find(which[e[1]]), find(which[e[2]])
            if x != y:
                part[x] = y
                took.append(e)
        want += took
        left = [e for e in left if e not in took]
    got, more = jaccard._forests(edges, which, 3)
    assert list(map(tuple, got)) == want and more == bool(left)
    some, _ = jaccard._forests(edges[:150], which, 3)
    got, _ = jaccard._forests(np.concatenate([some, edges[150:]]), which, 3)
    assert list(map(tuple, got)) == want


def test_other_sizes_and_empty_tables(spark):
    rows = made_rows(4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.ngram_components(docs, 5, 80).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)
    assert jaccard.ngram_components(docs.limit(0)).collect() == []


def test_one_document_of_each_group_stays(spark):
    rows = [(i, t, i) for i, t in made_rows(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    kept = jaccard.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    stays = {d for d, _, c in brute([r[:2] for r in rows], 5, 80) if d is not None and c == d}
    assert {r.doc_id for r in kept.collect()} - {None} == stays
    assert kept.filter("doc_id = 7").count() == 1 and kept.filter("doc_id IS NULL").count() == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 120), st.integers(0, 40), st.integers(0, 40), st.integers(0, 10 ** 6),
       st.sampled_from([0, 3, 10 ** 6]))
def test_similar_sets_share_a_key(size, add, drop, seed, sets):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2 ** 63, size).astype(np.uint64)
    b = np.concatenate([a[min(drop, size - 1):], rng.integers(0, 2 ** 63, add).astype(np.uint64)])
    both = len(np.intersect1d(a, b))
    similar = 100 * both >= 85 * (len(a) + len(b) - both)
    edges = np.array(jaccard.band_edges(200))
    plan = np.array([jaccard.allocate(int(lo) + 1, int(hi), sets)
                     for lo, hi in zip(np.append(0, edges), edges)])
    key, text = jaccard.signatures(
        np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]),
        np.array([len(a), len(b)]), edges, plan)
    if similar:
        assert len(np.intersect1d(key[text == 0], key[text == 1]))


def test_allocation_covers_all_differences():
    lo = 0
    for hi in jaccard.band_edges(5000):
        for sets in (0, 100, 10 ** 7):
            ones, twos, spare = jaccard.allocate(lo + 1, hi, sets)
            assert ones + 2 * twos >= jaccard.difference(hi) + 1 + spare
        lo = hi


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    links = [(i, i + 1) for i in range(0, 40)] + [
        (rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [
        (500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    part = {}
    for a, b in links:
        if a is None or a == b:
            continue
        pa, pb = part.setdefault(a, {a}), part.setdefault(b, {b})
        if pa is not pb:
            pa |= pb
            for x in pb:
                part[x] = pa
    assert got == {x: min(p) for x, p in part.items()}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_later_links_merge_components(spark):
    """Further links give the components of all links, from those that were there."""
    from foliospark.llm.components import components, merged

    def table(edges):
        return spark.createDataFrame(edges, "a bigint, b bigint")

    first, later = [(1, 2), (2, 3), (7, 8), (10, 11)], [(3, 8), (11, 30), (20, 21), (1, 2), (21, 22)]
    got = [tuple(r) for r in merged(components(table(first)), table(later)).collect()]
    assert sorted(got) == sorted(map(tuple, components(table(first + later)).collect()))
    same = merged(components(table(first)), table([])).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, components(table(first)).collect()))
