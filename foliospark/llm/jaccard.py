"""Documents whose sets of word n-grams overlap, without comparing all pairs.

Two sets with a Jaccard similarity of at least ``PERCENT`` per cent differ in at most H
elements. Sets are taken by size bands; within a band the universe of n-grams is dealt into
segments by hash, and each segment has a value: 1, matched when both sets have the same
elements there, or 2, matched also when one set has one element more (its one-deletion
neighbourhood is indexed). Segments that are not matched account for as many differences as
their value at least, so with values adding up to H + 1 + r a similar pair matches in segments
worth r + 1. The r spare ones let a set leave out keys of fewer than ``LEAST_KEY`` elements,
which unrelated sets share; a set with more such segments than r covers sends all its keys.

How many segments get the value 2 is a matter of cost, worked out for each band from the
number of its sets: one-deletion keys are many, but far fewer unrelated sets meet in them.

Two sets alone with a key are tested by their whole texts. In larger keys each set is first
tested with one set of the key only, which joins most of them. Keys whose sets are then still in
different components go on in rounds: their sets' sketches, which bound the difference from below,
are compared across components, the key gives out a spanning forest of its open pairs, nearest
first, and these are tested. The first round has short sketches, which leave more pairs open. Later
rounds have whole ones and only the sets of the open pairs that the round before did not give out;
they give out several forests, each of the pairs that those before it left. Rounds end when no key
holds an open pair that was not tested, so the components are those of all similar pairs. A key with
very many sets is split into pairs of blocks of its sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.components import components, merged
from foliospark.llm.repeats import _by, _groups, _sent, _unblob
from foliospark.llm.suffixes import expand
from foliospark.llm.texts import (BLANK_SPLIT, Texts, bounded_batches, mix, pieces, texts_of,
                                  windows_of, words_of)
from foliospark.session import stored

SHINGLE = 4
PERCENT = 85
#: Keys of fewer elements are left out where the spare segments allow it.
LEAST_KEY = 2
#: Sizes of one band are at most this many times its smallest.
BAND = 1.3
#: Cost model: the share of a band's sets that have a passage in common, the share of such a
#: set that the passage makes up, and keys that one test of two texts is worth.
SHARED_SETS, SHARED_PART, TEST_COST = 0.01, 0.15, 1
GROUP_BYTES = 16 << 20
#: Sets of a large key that a set is tested with at first, by what a task can see.
STARS = 2
#: Sets of a block of a key, and spanning forests that a block names in the first round; each
#: round more by the factor.
BLOCK, LAYERS, MORE = 4096, 1, 8
#: Open pairs of a block that are held before they are cut to its forests.
EDGES = 1 << 20


def shingle_sets(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(element, text) of the texts' sets, by text and element."""
    element, text = windows_of(words_of(texts.lower(), BLANK_SPLIT), size)
    by = np.argsort(element)
    if len(texts) < 1 << 16:
        by = by[np.argsort(text[by].astype(np.uint16), kind="stable")]
    else:
        by = by[np.argsort(text[by], kind="stable")]
    element, text = element[by], text[by]
    new = _groups(element, text)
    return element[new], text[new]


def _sums(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of 64-bit values by index, modulo 2 ** 64."""
    low = np.bincount(index, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    high = np.bincount(index, (values >> np.uint64(32)).astype(np.float64), size)
    with np.errstate(over="ignore"):
        return low.astype(np.uint64) + (high.astype(np.uint64) << np.uint64(32))


def fingerprints(element: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 64-bit fingerprint) of each set; equal sets have equal ones."""
    size = np.bincount(text, minlength=texts)
    return size, mix(_sums(text, mix(element), texts) + size.astype(np.uint64)).view(np.int64)


#: Bits of a sketch for each element in which a similar set can differ, and of a short one; a
#: power of two in all.
SKETCH, SHORT = 32, 16


def sketches(element: np.ndarray, text: np.ndarray, size: np.ndarray, percent: int,
             each: int = SKETCH) -> pa.Array:
    """The parity sketch of each set; the first half folded on the second is the shorter one."""
    differ = 2 * size * (100 - percent) // (100 + percent) + 1
    bits = 1 << np.ceil(np.log2(np.maximum(64, each * differ))).astype(np.int64)
    end = np.cumsum(bits)
    at = (end - bits)[text] + (mix(element + np.uint64(1)) % bits[text].astype(np.uint64)) \
        .astype(np.int64)
    odd = np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(size), [
        None, pa.py_buffer(np.append(0, end // 8).astype(np.int32).tobytes()),
        pa.py_buffer(data.tobytes())])


def _same_length(sketch: list[bytes]) -> np.ndarray:
    """Sketches folded to the shortest of them, as rows of 64-bit words."""
    least = min(map(len, sketch)) // 8
    rows = []
    for s in sketch:
        words = np.frombuffer(s, "<u8")
        while len(words) > least:
            words = words[:len(words) // 2] ^ words[len(words) // 2:]
        rows.append(words)
    return np.array(rows)


def difference(smaller: int, percent: int = PERCENT) -> int:
    """The most elements in which similar sets can differ, the smaller having at most that
    many."""
    total = smaller + smaller * 100 // percent
    # The overlap of sets with sizes adding up to t is percent * t / (100 + percent) at least.
    return max(t - 2 * -(-percent * t // (100 + percent)) for t in range(max(2, total - 3), total + 1))


def band_edges(largest: int) -> list[int]:
    """The largest size of each band."""
    edges, at = [], 1
    while not edges or edges[-1] < largest:
        edges.append(max(at, int(at * BAND)))
        at = edges[-1] + 1
    return edges


def allocate(smallest: int, largest: int, sets: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(segments of value 1, of value 2, spare value) of a band, the cheapest by the model."""
    need = difference(largest, percent) + 1
    mean = math.sqrt(smallest * largest * (100 + percent) / (2 * percent))
    best = None
    # Few numbers of value-2 segments are tried: none, all, and steps between.
    for twos in sorted({need * k // 16 for k in range(9)} | {need // 2, (need + 1) // 2}):
        ones = max(0, need - 2 * twos)
        if not ones + twos:
            continue
        spare = 0
        for _ in range(4):                            # spare segments make all smaller
            per = smallest / (ones + spare + twos)
            weak = math.exp(-per) * (1 + per)
            weak2 = weak + math.exp(-per) * per * per / 2
            expected = (ones + spare) * weak + 2 * twos * weak2
            spare = math.ceil(expected + 2 * math.sqrt(expected)) if need > 1 else 0
        per = mean / (ones + spare + twos)
        met = math.exp(-per * (1 - SHARED_PART))
        keys = ones + spare + twos * (1 + per)
        tests = sets * SHARED_SETS * met * ((ones + spare) + twos * (1 + per) ** 2)
        cost = keys + TEST_COST * tests
        if best is None or cost < best[0]:
            best = cost, (ones + spare, twos, spare)
    return best[1]


def signatures(element: np.ndarray, text: np.ndarray, size: np.ndarray, edges: np.ndarray,
               plan: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of all keys of some sets, in the scheme of their own band and of each lower
    band in which they can have a similar set. ``plan``: `allocate` of each band."""
    return labelled_signatures(element, text, size, edges, plan, percent)[:2]


def labelled_signatures(element, text, size, edges, plan, percent):
    """`signatures`, and the band and the segment of each key."""
    keys, owners, bands, segments = [], [], [], []
    own = np.searchsorted(edges, size)
    element = mix(element ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    steps = 0
    while True:
        band = own - steps
        use = (band >= 0) & (size > 0)
        if steps:
            use &= size <= edges[np.maximum(band, 0)] * 100 // percent
        if not use.any():
            break
        _scheme_keys(element, text, use, np.maximum(band, 0), plan, keys, owners, bands, segments)
        steps += 1
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(v) for v in (keys, owners, bands, segments))


def _scheme_keys(element, text, use, band, plan, keys, owners, bands, segments) -> None:
    there = use[text]
    element, text = element[there], text[there]
    ones, twos, spare = (plan[:, i][band] for i in range(3))
    count = np.where(use, ones + twos, 0)
    base = np.cumsum(count) - count
    total = int(count.sum())
    segment = base[text] + (element % count[text].astype(np.uint64)).astype(np.int64)
    held = np.bincount(segment, minlength=total)
    content = _sums(segment, element, total)
    owner = np.repeat(np.arange(len(use)), count)
    number = np.arange(total) - base[owner]
    two = number >= ones[owner]
    # What a set would lose by leaving out its small keys.
    loss = np.where(two, 2 * (held <= LEAST_KEY), held < LEAST_KEY)
    skips = np.bincount(owner, loss, len(use)) <= spare
    label = mix((band[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))

    def add(content, held, s):
        ok = (held >= LEAST_KEY) | ~skips[owner[s]]
        s = s[ok]
        with np.errstate(over="ignore"):
            keys.append(mix(content[ok] + held[ok].astype(np.uint64) + label[s]))
        owners.append(owner[s])
        bands.append(band[owner[s]])
        segments.append(number[s])

    add(content, held, np.arange(total))
    inner = two[segment]
    if inner.any():
        s = segment[inner]
        add(content[s] - element[inner], held[s] - 1, s)


def deal(plan: np.ndarray, edges: np.ndarray, sets: np.ndarray, group_bytes: int,
         percent: int) -> np.ndarray:
    """(first place, places) of each band's keys, by the bytes that its scheme is expected to
    send. Keys of one segment stay together as far as that goes, so that sets which share many
    keys meet in few places."""
    segments = np.maximum(plan[:, 0] + plan[:, 1], 1)
    keys = plan[:, 0] + plan[:, 1] * (1 + np.append(edges[:-1], edges[-1]) / segments)
    reach = np.searchsorted(edges, edges * 100 // percent, "right")
    total = np.append(0, np.cumsum(sets))
    sends = total[np.minimum(reach + 1, len(sets))] - total[:-1]
    places = np.maximum(1, np.ceil(16 * keys * sends / group_bytes)).astype(np.int64)
    return np.column_stack([np.cumsum(places) - places, places])


def _key_blobs(dealt: np.ndarray, shingle: int, edges: np.ndarray, plan: np.ndarray, percent: int):
    count = np.maximum(plan[:, 0] + plan[:, 1], 1)
    # Where a band has more places than segments, a segment has several.
    spread = -(-dealt[:, 1] // count)

    def send(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                element, text = shingle_sets(texts, shingle)
                size, print_ = fingerprints(element, text, len(texts))
                # Equal sets of a piece send their keys once.
                _, first = np.unique(print_, return_index=True)
                once = np.zeros(len(texts), dtype=bool)
                once[first] = True
                keep = once[text]
                key, owner, band, segment = labelled_signatures(
                    element[keep], text[keep], np.where(once, size, 0), edges, plan, percent)
                part = (key >> np.uint64(40)).astype(np.int64) % spread[band]
                place = dealt[band, 0] + (segment + count[band] * part) % dealt[band, 1]
                by = np.lexsort([owner, place])
                key, owner, place = key[by], owner[by], place[by]
                new = _groups(owner, place)
                # 40 bits of a key beside its place; more sets meet by chance, tests see to it.
                yield _sent(_by(place, low=key.astype(np.uint32), new=new,
                                high=(key >> np.uint64(32)).astype(np.uint8),
                                set=np.where(new, print_[owner], 0)))
    return send


_FOUND = "a bigint, b bigint, pair boolean, sets array<bigint>"


def _meet(table: pa.Table) -> pa.Table:
    """Sets with a key in common: (a, b, true) of two sets alone with a key, (a, b, false) of a
    set and one of those it shares most keys with as their least set, at most ``STARS`` of these
    for a set, and (null, their hash, null, all sets) of keys of three sets or more."""
    e = _unblob(table.column("blob").to_pylist())
    key = e["low"].astype(np.int64) | e["high"].astype(np.int64) << 32
    member = e["set"][np.maximum.accumulate(np.where(e["new"], np.arange(len(key)), 0))]
    by = np.lexsort([member, key])
    key, member = key[by], member[by]
    new = _groups(key, member)
    key, member = key[new], member[new]
    head = _groups(key)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(key)))
    two = first[size == 2]
    pairs = np.unique(np.column_stack([member[two], member[two + 1]]), axis=0)
    many = size >= 3
    least = np.repeat(member[first], size)
    other = ~head & np.repeat(many, size)
    stars, times = np.unique(np.column_stack([member[other], least[other]]), axis=0,
                             return_counts=True)
    by = np.lexsort([-times, stars[:, 0]])
    stars = stars[by]
    begin = _groups(stars[:, 0])
    rank = np.arange(len(stars)) - np.maximum.accumulate(np.where(begin, np.arange(len(stars)), 0))
    stars = stars[rank < STARS]
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat(mix(member.view(np.uint64)), first).view(np.int64) if len(first) \
            else np.zeros(0, np.int64)
    _, example = np.unique(hashes[many], return_index=True)
    chosen = np.flatnonzero(many)[example]
    _, slot = expand(first[chosen], first[chosen] + size[chosen])
    lists = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(size[chosen])).astype(np.int32)), pa.array(member[slot]))
    n, m, k = len(pairs), len(stars), len(chosen)
    return pa.table({
        "a": pa.concat_arrays([pa.array(np.append(pairs[:, 0], stars[:, 1])),
                               pa.nulls(k, pa.int64())]),
        "b": np.concatenate([pairs[:, 1], stars[:, 0], hashes[chosen]]),
        "pair": pa.concat_arrays([pa.array(np.arange(n + m) < n), pa.nulls(k, pa.bool_())]),
        "sets": pa.concat_arrays([pa.nulls(n + m, pa.list_(pa.int64())), lists])})


def _similar(shingle: int, percent: int):
    def test(batches):
        for batch in batches:
            at = 0
            while at < len(batch):
                rows = batch.slice(at, 64)
                at += 64
                left, right = (shingle_sets(texts_of(rows.column(i)), shingle) for i in (2, 3))
                n = len(rows)
                sizes = [np.bincount(t, minlength=n) for _, t in (left, right)]
                element = np.concatenate([left[0], right[0]])
                text = np.concatenate([left[1], right[1]])
                by = np.lexsort([element, text])
                element, text = element[by], text[by]
                same = (element[1:] == element[:-1]) & (text[1:] == text[:-1])
                both = np.bincount(text[1:][same], minlength=n)
                ok = 100 * both >= percent * (sizes[0] + sizes[1] - both)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(ok)], names=["a", "b", "similar"])
    return test


def _most(total: np.ndarray, percent: int) -> np.ndarray:
    """The most elements in which similar sets with sizes adding up to ``total`` differ."""
    return total - 2 * -(-percent * total // (100 + percent))


def _may_be_similar(percent: int):
    """The pairs whose sketches leave open that they are similar, with the least difference."""
    def bound(batches):
        for batch in batches:
            left, right = batch.column(3), batch.column(4)
            most = _most(left.field("n").to_numpy() + right.field("n").to_numpy(), percent)
            bits = np.array([int(np.bitwise_count(np.bitwise_xor(*_same_length([x, y]))).sum())
                             for x, y in zip(left.field("sketch").to_pylist(),
                                             right.field("sketch").to_pylist())], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(bits)],
                names=["a", "b", "pair", "bits"]).filter(pa.array(bits <= most))
    return bound


def _forest(p: np.ndarray, q: np.ndarray, nodes: int) -> np.ndarray:
    """Positions of the edges (p, q) of a spanning forest that prefers earlier edges: every
    round each tree takes its first edge to another tree."""
    label, at, kept = np.arange(nodes), np.arange(len(p)), []
    while True:
        x, y = label[p[at]], label[q[at]]
        out = x != y
        at, x, y = at[out], x[out], y[out]
        if not len(at):
            return np.sort(np.concatenate(kept)) if kept else at
        first = np.full((2, nodes), len(p))
        # The last write to a place stays, which is the first edge's.
        first[0, x[::-1]], first[1, y[::-1]] = at[::-1], at[::-1]
        first = first.min(0)
        tree = np.flatnonzero(first < len(p))
        edge = first[tree]
        kept.append(np.unique(edge))
        to = np.arange(nodes)
        to[tree] = label[p[edge]] + label[q[edge]] - tree
        # Two trees that take the same edge point at each other: the smaller one is the root.
        to = np.where((to[to] == np.arange(nodes)) & (np.arange(nodes) < to), np.arange(nodes), to)
        while not np.array_equal(to, to[to]):
            to = to[to]
        label = to[label]


def _forests(edges: np.ndarray, which: np.ndarray, layers: int) -> tuple[np.ndarray, bool]:
    """The edges (order, i, j) of ``layers`` forests between the components ``which``, each a
    forest of what those before it left, and whether edges are left. The edges of a part, joined
    with those of another part, have the same forests as both parts."""
    edges = edges[np.lexsort([edges[:, 2], edges[:, 1], edges[:, 0]])]
    kept = []
    for _ in range(layers):
        if not len(edges):
            break
        own = _forest(which[edges[:, 1]], which[edges[:, 2]], len(which))
        kept.append(edges[own])
        edges = np.delete(edges, own, axis=0)
    return np.concatenate(kept) if kept else edges, len(edges) > 0


def _cut(edges: np.ndarray, which: np.ndarray, layers: int) -> tuple[np.ndarray, np.ndarray]:
    """The edges of `_forests`, and for each node whether other edges of it are left."""
    kept, _ = _forests(edges, which, layers)
    degree, used = (np.bincount(e[:, 1:].ravel(), minlength=len(which)) for e in (edges, kept))
    return kept, degree > used


def _across(percent: int, layers: int):
    """Of a block of a key: of the pairs from different components that may be similar by their
    sketches, those of ``layers`` spanning forests, the nearest pairs first, as (a, b, null); and
    (their hash, null, the sets of the other such pairs) where there are more, which is the key of
    the next round. So a block of n sets names fewer than n pairs a layer, however many of its pairs
    are similar."""
    def pairs(batches):
        for batch in batches:
            found, more, lists = [], [], []
            members, begin = batch.column(1).flatten(), batch.column(1).offsets.to_numpy()
            begin = begin - begin[0]
            for lo, hi in zip(begin[:-1], begin[1:]):
                # Arrays of one key at a time: rows of a batch as objects are many times its size.
                own = members.slice(lo, hi - lo)
                node, part, n = (own.field(k).to_numpy() for k in ("node", "part", "n"))
                _, which, held = np.unique(part, return_inverse=True, return_counts=True)
                # The largest component is last: its sets are compared with all others' only.
                by = np.lexsort([node, which == held.argmax()])
                node, which, n = node[by], which[by], n[by]
                sketch = _same_length(own.field("sketch").take(pa.array(by)).to_pylist())
                edges, waiting, left = [], 0, np.zeros(len(node), dtype=bool)
                for i in range(len(node) - held.max()):
                    bits = np.bitwise_count(sketch[i] ^ sketch[i + 1:]).sum(1, dtype=np.int64)
                    spare = _most(n[i] + n[i + 1:], percent) - bits
                    near = np.flatnonzero((spare >= 0) & (which[i + 1:] != which[i]))
                    if len(near):
                        edges.append(np.column_stack([-spare[near], np.full(len(near), i),
                                                      near + i + 1]).astype(np.int32))
                        waiting += len(near)
                    if waiting > EDGES:
                        kept, beyond = _cut(np.concatenate(edges), which, layers)
                        edges, waiting = [kept], 0
                        left |= beyond
                if edges:
                    kept, beyond = _cut(np.concatenate(edges), which, layers)
                    left |= beyond
                    found.append(np.sort(node[kept[:, 1:]], axis=1))
                if left.any():
                    lists.append(np.sort(node[left]))
                    with np.errstate(over="ignore"):
                        more.append(mix(lists[-1].view(np.uint64)).sum(dtype=np.uint64))
            found = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            _, first = np.unique(np.array(more, np.uint64), return_index=True)
            more, lists = np.array(more, np.uint64)[first].view(np.int64), [lists[i] for i in first]
            sets = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_pydict({
                "a": pa.array(np.append(found[:, 0], more)),
                "b": pa.concat_arrays([pa.array(found[:, 1]), pa.nulls(len(more), pa.int64())]),
                "sets": pa.concat_arrays([pa.nulls(len(found), sets.type), sets])})
    return pairs


def _blocks(keys: DataFrame, parts: DataFrame, outline: DataFrame, block: int,
            whole: int) -> DataFrame:
    """(key, members) of keys (key, sets) with sets in several components: one row for a key of
    at most ``whole`` sets, else one for each two blocks of its sets with no two of the largest
    component."""
    members = keys.select("key", F.explode("sets").alias("node")).join(parts, "node", "left") \
        .withColumn("part", F.coalesce("component", "node")).drop("component")
    mixed = members.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("part", "c").alias("main"), F.max("c").alias("in_main"), F.sum("c").alias("c")) \
        .filter("c > in_main")
    p, q = (F.ceil(v / block).cast("int") for v in (F.col("c") - F.col("in_main"), F.col("in_main")))
    small = F.col("c") <= whole
    dealt = members.join(mixed, "key").withColumns({"p": p, "q": q})
    hashed = F.xxhash64("node")
    # A number given is kept: few bytes are much work here, and would be put into one task.
    spark = keys.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    i, j = F.pmod(hashed, "p").cast("int"), (F.col("p") + F.pmod(hashed, "q")).cast("int")
    slot = F.when(small, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).when(
        F.col("part") == F.col("main"),
        F.transform(F.sequence(F.lit(0), F.col("p") - 1),
                    lambda x: F.struct(x.alias("i"), j.alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("p") + F.col("q") - 1),
                    lambda x: F.struct(F.least(i, x).alias("i"), F.greatest(i, x).alias("j"))))
    return dealt.select("key", "node", "part", F.explode(slot).alias("at")) \
        .join(outline, "node").repartition(tasks, "key", "at").groupBy("key", "at").agg(
        F.collect_list(F.struct("node", "part", "n", "sketch")).alias("members")) \
        .select("key", "members")


def ngram_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                     group_bytes: int = GROUP_BYTES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row.

    ``component_id`` is the smallest doc_id that links lead to. A null or wordless text has an
    empty set, no links, and its own id. Rows of equal sets are one set; rows with the same
    doc_id are separate sets. A null doc_id gets the id of its component, if that has one.
    Elements are 64-bit hashes of n-grams, sets are known by 64-bit fingerprints.
    """
    docs = bounded_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def measure(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                element, text = shingle_sets(texts, shingle)
                size, print_ = fingerprints(element, text, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(size, pa.int64()), pa.array(print_),
                     sketches(element, text, size, percent),
                     sketches(element, text, size, percent, SHORT)],
                    names=["doc_id", "n", "set", "sketch", "short"])

    sizes = stored(docs.mapInArrow(
        measure, "doc_id bigint, n bigint, set bigint, sketch binary, short binary"), "sets")
    edges = np.array(band_edges(sizes.agg(F.max("n")).first()[0] or 1))
    # At most one row for each band: their number grows with the logarithm of the largest set.
    counts = sizes.filter("n > 0").groupBy("n").agg(F.approx_count_distinct("set").alias("c"))
    band = F.array_position(F.transform(F.array(*[F.lit(int(e)) for e in edges]),
                                        lambda e: e >= F.col("n")), True) - 1
    per_band = dict(counts.groupBy(band.alias("band")).agg(F.sum("c")).collect())
    plan = np.array([allocate(int(lo) + 1, int(hi), per_band.get(i, 0), percent)
                     for i, (lo, hi) in enumerate(zip(np.append(0, edges), edges))])

    dealt = deal(plan, edges, np.array([per_band.get(i, 0) for i in range(len(edges))]), group_bytes,
                 percent)
    found = stored(
        docs.mapInArrow(_key_blobs(dealt, shingle, edges, plan, percent), "place int, blob binary")
        .groupBy("place").applyInArrow(_meet, _FOUND), "met")
    classes = sizes.filter("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"))
    # Equal sets have equal sketches, so any row will do.
    outline = stored(sizes.filter("n > 0").select(F.col("set").alias("node"), "n", "sketch", "short")
                     .dropDuplicates(["node"]), "outline")

    def bounded(pairs: DataFrame) -> DataFrame:
        """(a, b, pair, bits) of the pairs that their sketches leave open."""
        sides = [outline.select(F.col("node").alias(k), F.struct("n", "sketch").alias(f"_{k}"))
                 for k in ("a", "b")]
        return stored(pairs.join(sides[0], "a").join(sides[1], "b")
                      .select("a", "b", "pair", "_a", "_b").mapInArrow(
                          _may_be_similar(percent), "a bigint, b bigint, pair boolean, bits bigint"),
                      "bounded")

    def tested(pairs: DataFrame) -> DataFrame:
        """(a, b, similar) by whole texts."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        texts = wanted.join(classes, "set").join(docs, "doc_id").select("set", "text")
        texts = stored(texts.mapInArrow(_own_text(shingle), "set bigint, text string")
                       .dropDuplicates(["set"]), "candidates")
        joined = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("x")), "a") \
            .join(texts.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
        return stored(joined.select("a", "b", "x", "y").mapInArrow(
            _similar(shingle, percent), "a bigint, b bigint, similar boolean"), "tested")

    start = bounded(found.filter("sets IS NULL").groupBy("a", "b").agg(F.max("pair").alias("pair")))
    nearest = start.filter("NOT pair").groupBy("b").agg(F.min_by("a", "bits").alias("a"))
    decided = tested(start.filter("pair").select("a", "b").unionByName(nearest))
    parts = stored(components(decided.filter("similar").select("a", "b")), "parts")
    keys = found.filter("sets IS NOT NULL").select(F.col("b").alias("key"), "sets") \
        .dropDuplicates(["key"])
    layers, whole, sketch = LAYERS, block, "short"
    while True:
        shown = outline.select("node", "n", F.col(sketch).alias("sketch"))
        out = stored(_blocks(keys, parts, shown, block, whole).mapInArrow(
            _across(percent, layers), "a bigint, b bigint, sets array<bigint>"), "pairs")
        new = out.filter("b IS NOT NULL").select("a", "b").distinct().join(
            decided.select("a", "b"), ["a", "b"], "left_anti")
        now = tested(bounded(new.withColumn("pair", F.lit(True))).select("a", "b"))
        if not now.filter("similar").isEmpty():
            parts = stored(merged(parts, now.filter("similar").select("a", "b")), "parts")
        more = out.filter("b IS NULL")
        if more.isEmpty():
            break
        decided = decided.unionAll(now)
        keys = more.select(F.col("a").alias("key"), "sets").dropDuplicates(["key"])
        # What two blocks leave is not split again.
        layers, whole, sketch = layers * MORE, 3 * block, "sketch"

    classes = classes.join(parts, classes.set == parts.node, "left").select(
        "set", "doc_id", F.coalesce("component", "set").alias("component"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = classes.join(least, "component").select("set", "component_id")
    linked = sizes.filter("n > 0").join(ids, "set").select("doc_id", "n", "component_id")
    return linked.unionAll(sizes.filter("n = 0").select(
        "doc_id", "n", F.col("doc_id").alias("component_id"))).withColumnRenamed("n", "n_shingles")


def _own_text(shingle: int):
    """Rows whose text has the set it was fetched for; ids can have several texts."""
    def keep(batches):
        for batch in batches:
            for rows, texts in pieces(batch):
                _, print_ = fingerprints(*shingle_sets(texts, shingle), len(texts))
                yield rows.filter(pa.array(rows.column(0).to_numpy() == print_))
    return keep


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows without near duplicates: of each component the document with the least id
    stays, of rows that share that id the one whose text sorts first. Texts without words have
    no duplicates, and rows without an id cannot be told apart; both stay."""
    found = ngram_components(docs.select("doc_id", "text"), shingle, percent)
    stays = found.filter("doc_id = component_id").groupBy("doc_id") \
        .agg(F.max("n_shingles").alias("_n"))
    columns = docs.columns
    named = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    id_, text = f"_{columns.index('doc_id')}", f"_{columns.index('text')}"
    first = F.row_number().over(Window.partitionBy(id_).orderBy(text)) == 1
    kept = named.join(stays, named[id_] == stays["doc_id"]).withColumn("_first", first) \
        .filter("_first OR _n = 0")
    rows = kept.select(named.columns).unionAll(named.filter(F.col(id_).isNull()))
    return rows.toDF(*columns)
