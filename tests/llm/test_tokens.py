"""Words, tokens, wavelet matrices and packing against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from foliospark.llm import packing, texts, wavelet
from foliospark.llm.tokens import Encoder, encoder, tokenizer_path
from hypothesis import given, settings
from hypothesis import strategies as st

BITS = ["a", "é", " ", "  ", " ", "　", "\n", "'s", "'", ".", "!", "9", "日本", " ",
        "<|endoftext|>", "\t", "\u0085", "🎉", "Ж", "\x1c", "﻿", " the", "Zu "]
ROWS = [(3, "one two. three"), (1, None), (2, ""), (None, "no id"), (3, "one two. three"),
        (3, "another text of id 3"), (7, "x" * 5000), (9, "Long. " * 3000)]


def some_texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def ids_of(text):
    tokenizer = encoder(tokenizer_path()).tokenizer
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_words_and_windows_are_those_of_the_pattern():
    given_ = [*some_texts(), None, "", " "]
    batch = pa.record_batch({"text": pa.array(given_)})
    for rows, t in texts.pieces(batch, size=300):
        for split, pattern in ((texts.BLANK_SPLIT, r"[^\x20\x09-\x0D]+"),
                               (texts.ALNUM_SPLIT, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            words = texts.words_of(t.lower(), split)
            for i, text in enumerate(rows.column(0).to_pylist()):
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
                got = [bytes(t.lower().data[a:b]).decode() for a, b in
                       zip(words.starts[words.first[i]:words.first[i + 1]],
                           words.ends[words.first[i]:words.first[i + 1]])]
                assert got == re.findall(pattern, low)
            hashes, owner = texts.windows_of(words, 4)
            counts = words.counts()
            assert list(np.bincount(owner, minlength=len(t))) == [
                max(c - 3, min(c, 1)) for c in counts]


def test_tokens_are_those_of_the_library():
    made = Encoder(tokenizer_path())
    batch = pa.record_batch({"text": pa.array([*some_texts(1500), None, "", " "])})
    for rows, t in texts.pieces(batch, size=2000):
        ids, begin, stops = made.encode(t)
        for i, text in enumerate(rows.column(0).to_pylist()):
            assert ids[begin[i]:begin[i + 1]].tolist() == ids_of(text)
        assert set(stops) <= set(range(len(ids)))


def test_new_units_go_to_the_tokenizer_many_at_a_time():
    made, given_ = Encoder(tokenizer_path()), []
    library = made.tokenizer

    class Counted:
        def encode_batch_fast(self, units, **options):
            given_.extend(units)
            return library.encode_batch_fast(units, **options)

    made.tokenizer = Counted()
    some = ["".join(f" w{i * 7}é<|endoftext|>'s" for i in range(2000)), "x  y\u3000 z a b\n"]
    ids, begin, _ = made.encode(texts.texts_of(pa.array(some)))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [ids_of(t) for t in some]
    assert len(given_) < 50
    # Bytes that are no UTF-8: their replacements are longer than they are.
    raw = b" one\xff two \xf0\x9f\x98 three \xe2\x82" + b" four" * 3
    data = np.frombuffer(raw, np.uint8)
    ids, _, _ = made.encode(texts.Texts(data, np.array([0, len(raw)])))
    assert ids.tolist() == ids_of(raw.decode("utf-8", "replace"))


def test_encoder_starts_over_when_full(monkeypatch):
    monkeypatch.setattr("foliospark.llm.tokens.REMEMBERED", 5)
    made = Encoder(tokenizer_path())
    for text in ("a b c d", "e f g h", "a b c d"):
        assert made.encode(texts.texts_of(pa.array([text])))[0].tolist() == ids_of(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=300))
def test_wavelet_matrix(ids):
    matrix = wavelet.WaveletMatrix.build(np.array(ids, np.uint32))
    record = wavelet.to_record(np.array(ids, np.uint32), [None, 5], [len(ids), 0])
    read, doc_ids, lengths = wavelet.from_record(record)
    assert doc_ids == [None, 5] and lengths.tolist() == [len(ids), 0]
    for m in (matrix, read):
        assert m.decode().tolist() == ids
        for at in range(0, len(ids), 37):
            assert m.access(at) == ids[at]
            assert m.rank(ids[at], at) == ids[:at].count(ids[at])
        for token in {*ids[:3], 0, 99999}:
            where = [i for i, x in enumerate(ids) if x == token]
            assert m.count(token) == len(where) and m.occurrences(token) == where


@pytest.mark.parametrize("shard_ids", [1, 50, 1 << 20])
def test_shards_round_trip(spark, shard_ids):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    got = wavelet.read_shards(wavelet.encode_shards(docs, shard_ids=shard_ids)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for doc_id, text in order:
        ids = np.array(ids_of(text), "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_shards_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert wavelet.read_shards(wavelet.encode_shards(docs)).collect() == []
    assert packing.pack(docs).collect() == []


def plain_cost(ends, stops, window, sentence_cost, inside_cost, inside_step):
    """The same least cost by trying every earlier place."""
    borders = sorted({0, *ends, *(s for s in stops if 0 < s < ends[-1])})
    cost = {b: 0 if b in ends or b == 0 else sentence_cost for b in borders}
    for a, b in zip(borders, borders[1:]):
        for x in range(a + inside_step, b, inside_step):
            cost[x] = inside_cost
    places = sorted(cost)
    best = {0: 0}
    for j in places[1:]:
        best[j] = cost[j] + min(
            best[i] + (0 if (j - i) & (j - i - 1) == 0 else window - (j - i))
            for i in places if j - window <= i < j)
    return best[places[-1]], cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=8), st.sets(st.integers(1, 300)))
def test_cuts_are_the_cheapest(sizes, stops):
    ends = np.cumsum(sizes)
    options = {"window": 32, "sentence_cost": 2, "inside_cost": 8, "inside_step": 7}
    got = packing.cuts(ends, np.array(sorted(stops), np.int64), **options)
    want, cost = plain_cost(ends.tolist(), stops, **options)
    sizes = np.diff(got)
    assert sizes.max() <= 32 and sizes.min() > 0
    paid = sum(0 if n & (n - 1) == 0 else 32 - n for n in sizes.tolist())
    assert paid + sum(cost[int(b)] for b in got) == want


@pytest.mark.parametrize("run_ids", [1, 3000, 1 << 20])
def test_packing_holds_every_id_once(spark, run_ids):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    rows = packing.pack(docs, run_ids=run_ids).collect()
    texts_of_id = {}
    for doc_id, text in ROWS:
        texts_of_id.setdefault(doc_id, []).append(np.array(ids_of(text), "<u4"))
    used, pieces = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0) and r.length > 0
        used[r.sequence_id] = r.offset + r.length
        assert any(len(ids) == r.doc_tokens
                   and zlib.crc32(ids[r.start:r.start + r.length]) == r.ids_crc32
                   for ids in texts_of_id[r.doc_id])
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert max(used.values()) <= 1024
    assert pieces == {k: sum(map(len, v)) for k, v in texts_of_id.items()}
