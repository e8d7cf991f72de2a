"""Repeated byte strings, benchmark matches and suffix arrays against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import decontaminate, repeats, suffixes, texts


def brute_repeats(rows, length=50):
    first = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            if doc_id is not None:
                s = raw[i:i + length]
                first[s] = min(first.get(s, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if doc_id is not None and first[raw[i:i + length]] < doc_id:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "é", "the", "of", "xyz", "日本", "aa", "q" * 12, "\n", ". "]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else
                 "".join(rng.choice("abcdef é") for _ in range(rng.randint(0, 80)))
                 for _ in range(rng.randint(0, 5))]
        text = "".join(parts)
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + "#" + text[at + 1:]
        rows.append((i * 3 - 20, text))
    return rows


EDGE = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 49), (5, "b" + "a" * 300 + "b"),
        (6, "ab" * 200), (7, "ba" * 150), (8, "x" * 50), (8, "x" * 50), (9, "y" + "x" * 50),
        (9, "x" * 50 + "z"), (None, "x" * 80), (10, "the the " * 100), (11, "the the " * 90),
        (12, "日本語" * 40), (13, "本語日" * 40), (14, "a" * 4000), (15, "\0" * 60), (16, "\0" * 70)]


@pytest.mark.parametrize("seed,shard,group", [(1, 1 << 21, 1 << 24), (2, 700, 900), (3, 150, 400)])
def test_repeats_are_those_of_brute_force(spark, seed, shard, group):
    rows = made_rows(seed) + EDGE * (seed == 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeats.find_repeats(docs, shard_bytes=shard, group_bytes=group).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_repeats(rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame(EDGE, "doc_id bigint, text string")
    got = repeats.find_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_repeats(EDGE)
    assert repeats.find_repeats(docs.limit(0)).collect() == []


def test_texts_without_repeats_keep_whole_characters(spark):
    rows = [(1, "é" * 30, "k", 30), (2, "x" + "é" * 30 + "y", None, 0), (3, None, "n", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, blob string, n_chars bigint")
    got = {r.doc_id: tuple(r) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: rows[0], 2: (2, "xy", None, 2), 3: rows[2]}
    assert repeats.remove_repeats(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rng = random.Random(seed)
    texts_ = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(6)]
    symbols = np.frombuffer("".join(texts_).encode(), np.uint8).astype(np.uint64)
    ends = np.repeat(np.cumsum([len(t) for t in texts_]), [len(t) for t in texts_])
    order, _ = suffixes.suffix_array(symbols, ends, 64)
    whole = bytes(symbols.astype(np.uint8))
    found = [whole[i:ends[i]] for i in order]
    assert found == sorted(found) and sorted(order) == list(range(len(whole)))
    queries = ["ab", "a", "bbb", "abab", "zz"]
    rows = np.zeros((5, 4), np.uint64)
    for i, q in enumerate(queries):
        rows[i, :len(q)] = list(q.encode())
    low, high = suffixes.search(symbols, ends, order, rows, np.array([len(q) for q in queries]))
    for q, a, b in zip(queries, low, high):
        assert sorted(order[a:b]) == [i for i in range(len(whole))
                                      if whole[i:ends[i]].startswith(q.encode())]


def test_common_prefixes():
    data = np.frombuffer(b"banana bandana banana", np.uint8)
    order = suffixes.suffix_array(data.astype(np.uint64), np.full(len(data), len(data)), 64)[0]
    raw = data.tobytes()
    for i, got in enumerate(suffixes.common_prefixes(data, order, 10)):
        a, b = raw[order[i]:], raw[order[i + 1]:]
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert got == min(want, 10)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_hits(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        for x in ([tuple(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size
                  else [tuple(w)] if w else []):
            windows.setdefault(x, set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(ids),
                    hashlib.sha256(",".join(ids).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(4 << 20, 32 << 20), (60, 80)])
def test_contamination_is_that_of_brute_force(spark, shard, block, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["Alpha", "beta", "é9", "x", "naïve", "42", "日本"]
    run = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, run(rng.randint(14, 30))) for i in range(12)]
    items += [(100, "only three words"), (101, ""), (102, None), (None, run(20)), (3, run(15)),
              (12, items[2][1]), (11, items[2][1])]
    docs = [(i, " ".join([run(rng.randint(0, 30)), rng.choice(items)[1] or "", run(3),
                          "Only THREE, words!" if i % 9 == 0 else ""])) for i in range(50)]
    docs += [(60, None), (61, ""), (62, " "), (61, items[1][1]), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    find = decontaminate.find_matches
    monkeypatch.setattr(decontaminate, "find_matches", lambda *a, **k: find(
        *a, **k, shard_bytes=shard, block_bytes=block))
    got = decontaminate.contamination(d, b).collect()
    assert sorted(map(tuple, got), key=str) == brute_hits(docs, items)
    kept = {tuple(r) for r in decontaminate.drop_contaminated(d, b).collect()}
    bad = {(r[0], r[1]) for r in brute_hits(docs, items) if r[5]}
    assert kept == {r for r in docs if (r[0], len(words(r[1]))) not in bad}
    empty = decontaminate.contamination(d, b.limit(0)).filter("contaminated OR n_hit > 0")
    assert empty.count() == 0
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_longest_matches_carry_their_places(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "a b " + item + " c", "x")],
                                 "doc_id bigint, text string, n_words string")
    b = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    row = decontaminate.find_matches(docs, b).first()
    assert [tuple(m) for m in row.matches] == [(7, 0, 2, 30)] and row.n_hit == 30
    assert decontaminate.drop_contaminated(docs, b).columns == docs.columns


def test_pieces_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * n for n in (5, 0, 30, 2, 2)])})
    sizes = [(len(r), len(t.data)) for r, t in texts.pieces(batch, size=6)]
    assert sum(n for n, _ in sizes) == 5 and sum(b for _, b in sizes) == 39


def test_adjacent_repeated_rows_of_a_text_with_several_stretches(spark):
    rng = random.Random(9)
    text, more = ("".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(2))
    rows = [(3, text + more), (5, text), (5, text), (6, more), (6, more)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = repeats.find_repeats(docs, shard_bytes=1850).collect()    # shards are 3, 5 and 5, 6 and 6
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_repeats(rows)


@pytest.mark.parametrize("spread", [(2, 1 << 30), (1 << 30, 2), (3, 4)])
def test_repeats_of_spread_anchors_are_those_of_brute_force(spark, spread):
    rng = random.Random(6)
    rows = made_rows(4, 70) + EDGE + [
        (200 + i // 2, "".join(rng.choice("abcdefgh ") for _ in range(60)) + "the shared words " * (i % 3)
         + "A passage that many documents have, after a text of their own." + str(i))
        for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeats.find_repeats(docs, shard_bytes=2500, group_bytes=3000, spread=spread).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got),
                  key=str) == brute_repeats(rows)


def test_a_shared_passage_goes_to_many_buckets():
    rng = random.Random(7)
    own = ["".join(rng.choice("abcdefgh ") for _ in range(80)) for _ in range(1200)]
    passage = "This licence text stands in a third of all documents, after another text in each."
    batch = pa.record_batch({"doc_id": pa.array(range(600)), "text": pa.array(
        [a + passage + b for a, b in zip(own[:600], own[600:])])})
    entries, strings = [], {}
    for out in repeats._anchor_entries(16, 50, 16, 1 << 21)([batch]):
        for place, blob in zip(*(out.column(i).to_pylist() for i in range(2))):
            if 0 <= place < 16:
                entries += repeats._read_entries([blob])["anchor"].tolist()
            elif place >= 16:
                strings[place] = len(repeats._unblob([blob])["string"])
    assert max(np.unique(entries, return_counts=True)[1]) < 32
    assert len(strings) == 16 and max(strings.values()) < sum(strings.values()) / 8
