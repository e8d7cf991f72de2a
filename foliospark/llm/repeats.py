"""Removal of byte strings that documents with smaller ids have already.

A byte goes when a string of ``LENGTH`` bytes over it also starts in a document with a smaller
doc_id. Comparing the suffix array of each shard with that of every other one would take time
with the square of the input, so suffixes meet by content:

1. Each string of ``LENGTH`` bytes has an anchor, its ``GRAM``-byte substring of least hash;
   equal strings have equal anchors. Neighbouring strings of one anchor form a stretch of text.
   Shards of a few MB send (anchor, hash of the stretch, document, place) to the bucket of the
   anchor, one document for each stretch that several of them share.
2. A bucket merges its shards' sorted runs. A stretch that a smaller document has as a whole
   is a repeat; an anchor of one document only is none. What is left are anchors with several
   stretches: their copies begin or end within the stretch.
3. The text of those stretches meets by anchor again, in shards with a suffix array
   (Larsson-Sadakane) and common prefixes; suffixes with ``LENGTH`` bytes in common form one
   group, and its smallest document keeps the string. Sub-shards of a large bucket look their
   strings up in each other's arrays by bisection.

An anchor with very many open stretches (the border of a passage that many documents share) is
spread instead: each shard or group of documents settles the strings that it has itself under a
smaller doc_id, and sends those of the least one singly to the bucket of the string's hash. A
shard that does so tells the bucket of the anchor, which then has all others do the same.

Documents and what was found about them come together in groups by a hash of doc_id, each of
about ``GROUP_BYTES`` of text.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from foliospark.llm.suffixes import common_prefixes, expand, suffix_array
from foliospark.llm.texts import (bounded_batches, eight_bytes, give_back, hashes_of, mix, pieces,
                                  texts_of)
from foliospark.session import stored

LENGTH = 50
GRAM = 16
#: Text bytes of a shard whose anchors are sorted together.
SHARD_BYTES = 2 << 20
#: Text bytes that a bucket or a group of documents stands for.
GROUP_BYTES = 16 << 20
#: Strings of one stretch at most.
STRETCH = 200
#: Open stretches of an anchor, in a shard and in a bucket, from which on it is spread.
SPREAD_SHARD, SPREAD_BUCKET = 32, 4096

# Odd 64-bit constants of the gram hash.
_SEED, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_RESULT = ("doc_id bigint, text_key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
           "kept_sha256 string, removed array<bigint>")
_ROW = pa.schema([
    ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_bytes", pa.int64()),
    ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("removed", pa.list_(pa.int64()))])


def _blob(**columns: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
    with pa.ipc.new_stream(sink, batch.schema,
                           options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unblob(blobs: list[bytes]) -> dict[str, np.ndarray]:
    give_back()
    return _columns(pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]))


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {n: table.column(n).combine_chunks().to_numpy(zero_copy_only=False)
            for n in table.column_names}


def _stretches(texts, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start in the bytes, number of strings, anchor, hashes of what stands before and
    behind the anchor) of every stretch.

    A string has half of what it is longer than the anchor on one side of it at least, so two
    strings are equal only where one of the two one-byte hashes is. They are 0 where a stretch
    has its anchor more than once.
    """
    data = texts.data
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none, none
    view = eight_bytes(data)[:n]
    with np.errstate(over="ignore"):
        low = np.full(n, np.uint64(gram)) * _SEED
        for at in range(0, gram, 8):
            word = np.zeros(n, np.uint64)
            word[:n - at] = view[at:]
            if gram - at < 8:
                word &= np.uint64((1 << 8 * (gram - at)) - 1)
            low = (low ^ word) * _ODD
            low ^= low >> np.uint64(31)
    # The least of all grams of each string, by doubling.
    own, width, reach = low.copy(), length - gram + 1, 1
    while reach * 2 <= width:
        low[:n - reach] = np.minimum(low[:n - reach], low[reach:])
        reach *= 2
    if reach < width:
        low[:n - width + reach] = np.minimum(low[:n - width + reach], low[width - reach:])
    sizes = texts.sizes()
    counts = np.maximum(sizes - length + 1, 0)
    text, place = expand(np.zeros(len(counts), np.int64), counts)
    at = texts.offsets[:-1][text] + place
    value = low[at]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(head)
    run = np.diff(np.append(first, len(at)))
    if len(run) and run.max() > STRETCH:              # long periodic texts
        part, nth = expand(np.zeros(len(run), np.int64), -(-run // STRETCH))
        first = first[part] + nth * STRETCH
        run = np.minimum(STRETCH, run[part] - nth * STRETCH)
    text, start, anchor = text[first], at[first], value[first]
    seen, place = np.zeros(len(start), np.int64), start.copy()
    rows = np.arange(len(start))
    for k in range(2 * width - 1):
        rows = rows[run[rows] + width - 1 > k]
        here = rows[own[start[rows] + k] == anchor[rows]]
        place[here[seen[here] == 0]] += k
        seen[here] += 1
    side = (length - gram) // 2
    lo, hi = texts.offsets[:-1][text], texts.offsets[1:][text]
    sides = []
    for a, b in ((np.maximum(place - side, lo), place),
                 (place + gram, np.minimum(place + gram + side, hi))):
        once = (hashes_of(data, a, b) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        sides.append(np.where((seen == 1) & (run <= width), once, np.uint8(0)))
    return text, start, run, anchor, *sides


def _text_keys(texts) -> np.ndarray:
    """32-bit hashes that tell apart the texts of rows with the same doc_id."""
    return (hashes_of(texts.data, texts.offsets[:-1], texts.offsets[1:])
            >> np.uint64(32)).astype(np.int64)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal sorted keys begin."""
    head = np.ones(len(keys[0]), dtype=bool)
    if len(head):
        head[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return head


def _place_of(doc_id: np.ndarray, places: int) -> np.ndarray:
    return (mix(doc_id.astype(np.int64).view(np.uint64)) % np.uint64(places)).astype(np.int32)


def _by(at: np.ndarray, **columns):
    """(place, blob) of the rows of each place."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    for a, b in _ranges(_groups(at)):
        yield int(at[a]), _blob(**{k: v[order[a:b]] for k, v in columns.items()})


def _ranges(head: np.ndarray):
    first = np.flatnonzero(head).tolist()
    return zip(first, first[1:] + [len(head)])


def _sent(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())],
                                      names=["place", "blob"])


def _entry_blobs(places: int, text, anchor, stretch, doc, key, start, run, before, behind):
    """Entries of a shard by place, in text order: 40 bits of the anchor besides the place, 48
    of the stretch, and what zstd makes small (steps of the start, rows of one text)."""
    order = np.argsort(anchor % np.uint64(places), kind="stable")
    place = (anchor % np.uint64(places))[order].astype(np.int64)
    anchor = mix(anchor[order])
    text, stretch, doc, key, start, run, before, behind = (
        v[order] for v in (text, stretch, doc, key, start, run, before, behind))
    for a, b in _ranges(_groups(place)):
        row = _groups(text[a:b])                      # repeated rows have the same doc and key
        step = np.diff(start[a:b], prepend=0)
        step[row] = start[a:b][row]
        yield int(place[a]), _blob(
            anchor=(anchor[a:b] >> np.uint64(32)).astype(np.uint32),
            anchor_low=(anchor[a:b] & np.uint64(255)).astype(np.uint8),
            stretch=(stretch[a:b] >> np.uint64(32)).astype(np.uint32),
            stretch_low=(stretch[a:b] & np.uint64(65535)).astype(np.uint16),
            step=step.astype(np.uint32), run=run[a:b].astype(np.uint8), row=row,
            before=before[a:b], behind=behind[a:b]) + _blob(
            doc=doc[a:b][row], key=key[a:b][row].astype(np.uint32))


def _many_open(anchor, before, behind, least: int) -> np.ndarray:
    """The anchors that ``least`` of some different stretches have with the same hash beside."""
    spread = np.zeros(len(anchor), dtype=bool)
    for side in (before, behind):
        order = np.lexsort([side, anchor])
        first = np.flatnonzero(_groups(anchor[order], side[order]))
        size = np.diff(np.append(first, len(order)))
        spread[order] |= np.repeat(size >= least, size)
    return np.unique(anchor[spread])


def _runs(start: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row, number) of the runs of consecutive starts of one owner, ``STRETCH`` at most."""
    follows = np.zeros(len(start), dtype=bool)
    follows[1:] = (start[1:] == start[:-1] + 1) & ~_groups(*owner)[1:]
    first = np.flatnonzero(~follows)
    run = np.diff(np.append(first, len(start)))
    part, nth = expand(np.zeros(len(run), np.int64), -(-run // STRETCH))
    return first[part] + nth * STRETCH, np.minimum(STRETCH, run[part] - nth * STRETCH)


def _spread(places: int, length: int, data, at, run, doc, key, start):
    """(which strings of some stretches are repeats among themselves, columns of all strings, the
    bucket of each). ``at`` is where a stretch begins in the data, ``start`` where in its text."""
    row, nth = expand(np.zeros(len(run), np.int64), run)
    where = at[row] + nth
    string = hashes_of(data, where, where + length)
    e = {"string": string, "doc": doc[row], "key": key[row], "start": start[row] + nth}
    order = np.lexsort([e["doc"], string])
    least = e["doc"][order][np.maximum.accumulate(
        np.where(_groups(string[order]), np.arange(len(order)), 0))]
    repeat = np.zeros(len(order), dtype=bool)
    repeat[order] = e["doc"][order] > least
    return repeat, e, places + (mix(string) % np.uint64(places)).astype(np.int64)


def _read_entries(blobs: list[bytes]) -> dict[str, np.ndarray]:
    found = []
    for blob in blobs:
        source = pa.BufferReader(blob)
        e, rows = (_columns(pa.ipc.open_stream(source).read_all()) for _ in range(2))
        head = e["row"].astype(bool)
        at = np.cumsum(head) - 1
        through = np.cumsum(e["step"].astype(np.int64))
        first = np.flatnonzero(head)
        found.append({
            "anchor": (e["anchor"].astype(np.uint64) << np.uint64(8)) | e["anchor_low"],
            "stretch": (e["stretch"].astype(np.uint64) << np.uint64(16)) | e["stretch_low"],
            "doc": rows["doc"][at], "key": rows["key"].astype(np.int64)[at],
            "start": through - (through[first] - e["step"][first])[at], "run": e["run"],
            "before": e["before"], "behind": e["behind"]})
    return {k: np.concatenate([f[k] for f in found]) for k in found[0]}


def _anchor_entries(places: int, length: int, gram: int, shard_bytes: int,
                    spread: int = SPREAD_SHARD):
    """Step 1. Places below zero are groups of documents: what the shard has settled itself.
    Those from ``places`` on are buckets of strings. A stretch of no strings says that the shard
    has spread its anchor."""
    def settled(doc, key, start, run):
        n = len(doc)
        return ((-1 - p, b) for p, b in _by(
            _place_of(doc, places), doc=doc, key=key, start=start, run=run.astype(np.uint8),
            anchor=np.zeros(n, np.uint64), whole=np.ones(n, bool), spread=np.zeros(n, bool)))

    def entries(batches):
        for batch in batches:
            for rows, texts in pieces(batch, size=shard_bytes):
                ids = rows.column(0)
                doc_of = ids.fill_null(0).to_numpy(zero_copy_only=False)
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                found = _stretches(texts, length, gram)
                ok = known[found[0]]
                text, at, run, anchor, before, behind = (v[ok] for v in found)
                if not len(text):
                    continue
                stretch = hashes_of(texts.data, at, at + run + (length - 1))
                doc, key = doc_of[text], _text_keys(texts)[text]
                start = at - texts.offsets[:-1][text]
                order = np.lexsort([doc, stretch, anchor])
                head = _groups(anchor[order], stretch[order])
                least = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
                repeat = np.zeros(len(doc), dtype=bool)
                repeat[order] = doc[order] > least
                new = np.flatnonzero(~repeat)
                once = order[head]
                hot = new[np.isin(anchor[new], _many_open(
                    anchor[once], before[once], behind[once], spread))]
                if len(hot):
                    again, e, place = _spread(places, length, texts.data, at[hot], run[hot],
                                              doc[hot], key[hot], start[hot])
                    yield _sent(_by(place[~again], **{k: v[~again] for k, v in e.items()}))
                    if again.any():
                        gone = {k: v[again] for k, v in e.items()}
                        first, size = _runs(gone["start"], gone["doc"], gone["key"])
                        yield _sent(settled(gone["doc"][first], gone["key"][first],
                                            gone["start"][first], size))
                    # One empty stretch for each spread anchor stands for all of them.
                    _, one = np.unique(anchor[hot], return_index=True)
                    told = np.sort(hot[one])
                    run[told] = 0
                    new = np.sort(np.append(np.setdiff1d(new, hot), told))
                yield _sent(_entry_blobs(places, *(v[new] for v in (
                    text, anchor, stretch, doc, key, start, run, before, behind))))
                if repeat.any():
                    yield _sent(settled(doc[repeat], key[repeat], start[repeat], run[repeat]))
    return entries


def _may_meet(anchor, doc, before, behind) -> np.ndarray:
    """Which stretches have the hash before or the one behind the anchor in common with a
    stretch of another document. Anchors come sorted; a hash of 0 meets all."""
    met = np.zeros(len(anchor), dtype=bool)
    for side in (before, behind):
        order = np.lexsort([side, anchor])
        first = np.flatnonzero(_groups(anchor[order], side[order]))
        size = np.diff(np.append(first, len(order)))
        if len(first):
            d = doc[order]
            met[order] |= np.repeat(np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first),
                                    size)
    if len(anchor):
        first = np.flatnonzero(_groups(anchor))
        size = np.diff(np.append(first, len(anchor)))
        several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
        met |= np.repeat(several & (np.minimum.reduceat(before, first) == 0), size)
    return met


def _merge_bucket(places: int, spread: int = SPREAD_BUCKET):
    """Step 2: (group of documents, stretches that are repeats or still open). Strings that were
    sent singly pass through."""
    def merged(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        blobs = table.column("blob").to_pylist()
        if place < 0:
            return pa.Table.from_batches([_sent((-1 - place, b) for b in blobs)])
        if place >= places:
            return table
        e = _read_entries(blobs)
        told = np.unique(e["anchor"][e["run"] == 0])
        e = {k: v[e["run"] > 0] for k, v in e.items()}
        if not len(e["doc"]):
            return pa.Table.from_batches([_sent([])])
        order = np.lexsort([e["doc"], e["stretch"], e["anchor"]])
        e = {k: v[order] for k, v in e.items()}
        new_anchor = _groups(e["anchor"])
        new_stretch = _groups(e["anchor"], e["stretch"])
        first = np.flatnonzero(new_anchor)
        group = np.cumsum(new_anchor) - 1
        several_docs = (np.minimum.reduceat(e["doc"], first)
                        < np.maximum.reduceat(e["doc"], first))[group]
        least = e["doc"][np.maximum.accumulate(np.where(new_stretch, np.arange(len(group)), 0))]
        whole = e["doc"] > least
        # One row for each stretch that could have a string in common with another one's.
        rows = np.flatnonzero(new_stretch & several_docs)
        opened = np.zeros(len(group), dtype=bool)
        opened[rows] = _may_meet(*(e[k][rows] for k in ("anchor", "doc", "before", "behind")))
        spreads = np.bincount(group, opened)[group] >= spread
        if len(told):
            here = np.isin(e["anchor"], told)
            spreads |= here
            opened |= here & new_stretch
        opened = opened[np.maximum.accumulate(np.where(new_stretch, np.arange(len(group)), 0))]
        keep = whole | opened
        out = {k: e[k][keep] for k in ("doc", "key", "start", "run")}
        # Anchors of another bucket are others, even with the same 40 bits.
        out["anchor"] = mix(e["anchor"][keep] + np.uint64(place << 40))
        return pa.Table.from_batches([_sent(_by(_place_of(out["doc"], places), **out,
                                                whole=whole[keep], spread=spreads[keep]))])
    return merged


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _mask(size: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def _table_blob(table: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _text_blobs(places: int, shard_bytes: int):
    """Whole rows, packed by group of documents; rows without id by a hash of the text."""
    def send(batches):
        for batch in batches:
            for rows, texts in pieces(batch, size=shard_bytes):
                ids = rows.column(0)
                keys = _text_keys(texts)
                doc = np.where(ids.is_valid().to_numpy(zero_copy_only=False),
                               ids.fill_null(0).to_numpy(zero_copy_only=False), keys)
                place = _place_of(doc, places)
                order = np.argsort(place, kind="stable")
                yield _sent((int(place[order[a]]), _table_blob(rows.take(pa.array(order[a:b]))))
                            for a, b in _ranges(_groups(place[order])))
    return send


def _ranges_of(found: pa.Table, names: tuple[str, ...]) -> tuple[dict, dict]:
    """(columns, row range of each (doc, key)) of what was found for a group."""
    blobs = found.column("blob").to_pylist()
    f = _unblob(blobs) if blobs else {k: np.zeros(0, np.int64) for k in names}
    order = np.lexsort([f["key"], f["doc"]])
    f = {k: v[order] for k, v in f.items()}
    return f, {(int(f["doc"][a]), int(f["key"][a])): (a, b)
               for a, b in _ranges(_groups(f["doc"], f["key"]))}


def _unpacked(docs: pa.Table) -> pa.Table | None:
    """The rows of a group of documents."""
    blobs = docs.column("blob").to_pylist()
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]) if blobs else None


def _documents(rows: pa.Table | None, found: pa.Table):
    """(doc_id, key, bytes, its rows of ``found``) of the documents of a group."""
    more = found.column("blob").to_pylist()
    if rows is None:
        return
    texts = texts_of(rows.column("text"))
    f = _unblob(more) if more else {"doc": np.zeros(0, np.int64), "key": np.zeros(0, np.int64)}
    order = np.lexsort([f["key"], f["doc"]])
    f = {k: v[order] for k, v in f.items()}
    ranges = {(int(f["doc"][a]), int(f["key"][a])): (a, b)
              for a, b in _ranges(_groups(f["doc"], f["key"]))}
    for i, (doc_id, key) in enumerate(zip(rows.column("doc_id").to_pylist(),
                                          _text_keys(texts).tolist())):
        a, b = ranges.get((doc_id, key), (0, 0))
        yield (doc_id, key, texts.data[texts.offsets[i]:texts.offsets[i + 1]],
               {k: v[a:b] for k, v in f.items()})


def _open_texts(places: int, length: int):
    """Repeats of a group (place below zero) and the text of its open stretches, or of spread
    ones the strings."""
    def opened(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not len(docs) and len(found) and found.column("place")[0].as_py() >= places:
            return found
        seen, whole, sent, texts, single, parts, size = set(), [], [], [], [], [], 0
        for doc_id, key, raw, f in _documents(_unpacked(docs), found):
            if not len(f["doc"]) or (doc_id, key) in seen:
                continue
            seen.add((doc_id, key))
            start = f["start"].astype(np.int64)
            end = start + f["run"].astype(np.int64) + (length - 1)
            done = f["whole"].astype(bool)
            a, b = _spans(_mask(len(raw), start[done], end[done]))
            whole.append((np.full(len(a), doc_id), np.full(len(a), key), a, b))
            hot = np.flatnonzero(~done & f["spread"].astype(bool))
            if len(hot):
                single.append((size + start[hot], f["run"][hot].astype(np.int64), f["doc"][hot],
                               f["key"][hot], start[hot]))
                parts.append(raw)
                size += len(raw)
            left = np.flatnonzero(~done & ~f["spread"].astype(bool))
            sent.append((f["anchor"][left], f["doc"][left], f["key"][left], start[left]))
            texts += [raw[x:y].tobytes() for x, y in zip(start[left].tolist(), end[left].tolist())]
        out = []
        if single:
            again, e, place = _spread(places, length, np.concatenate(parts),
                                      *(np.concatenate(c) for c in zip(*single)))
            out += _by(place[~again], **{k: v[~again] for k, v in e.items()})
            gone = {k: v[again] for k, v in e.items()}
            if again.any():
                first, run = _runs(gone["start"], gone["doc"], gone["key"])
                a = gone["start"][first]
                whole.append((gone["doc"][first], gone["key"][first], a, a + run + (length - 1)))
        if seen:
            doc, key, a, b = (np.concatenate(c) for c in zip(*whole))
            if len(doc):
                out.append((-1 - docs.column("place")[0].as_py(),
                            _blob(doc=doc, key=key, start=a, end=b)))
            anchor, doc, key, start = (np.concatenate(c) for c in zip(*sent))
            out += _by((anchor % np.uint64(places)).astype(np.int64), doc=doc, key=key,
                       start=start, text=np.array(texts, dtype=object))
        return pa.Table.from_batches([_sent(out)])
    return opened


class _Shard:
    """Strings of some open stretches: sorted, with the smallest document of each."""

    def __init__(self, stretches: dict[str, np.ndarray], length: int):
        self.stretches, self.length = stretches, length
        size = np.fromiter(map(len, stretches["text"]), np.int64, len(stretches["text"]))
        data = np.frombuffer(b"".join(stretches["text"]), np.uint8)
        begin = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        ends = np.full(len(data), len(data))
        order = suffix_array(eight_bytes(data)[:len(data)].byteswap(), ends, length, width=8)[0]
        order = order[(begin + size)[row[order]] - order >= length]
        head = np.append(True, common_prefixes(data, order, length) < length)
        first = np.flatnonzero(head)
        self.order, self.row, self.group = order, row[order], np.cumsum(head) - 1
        self.start = stretches["start"][self.row] + order - begin[self.row]
        self.doc = stretches["doc"][self.row]
        self.least = np.minimum.reduceat(self.doc, first)
        strings = np.lib.stride_tricks.sliding_window_view(data, length)[order[first]]
        self.strings = np.ascontiguousarray(strings).view(f"S{length}").ravel()

    def meet(self, other: _Shard) -> None:
        """Look up each other's strings by bisection; both take the smaller document."""
        at = np.searchsorted(other.strings, self.strings)
        at[at == len(other.strings)] = 0
        mine = np.flatnonzero(other.strings[at] == self.strings)
        theirs = at[mine]
        least = np.minimum(self.least[mine], other.least[theirs])
        self.least[mine] = least
        other.least[theirs] = least

    def repeats(self) -> dict[str, np.ndarray]:
        at = np.flatnonzero(self.doc > self.least[self.group])
        return {"doc": self.doc[at], "key": self.stretches["key"][self.row[at]],
                "start": self.start[at], "end": self.start[at] + self.length}


def _resolve(places: int, length: int, shard_bytes: int):
    """Step 3: strings of the open stretches of a bucket, or those that were sent singly."""
    def resolved(table: pa.Table) -> pa.Table:
        e = _unblob(table.column("blob").to_pylist())
        if table.column("place")[0].as_py() >= places:
            order = np.lexsort([e["doc"], e["string"]])
            doc, head = e["doc"][order], _groups(e["string"][order])
            at = order[doc > doc[np.maximum.accumulate(np.where(head, np.arange(len(doc)), 0))]]
            start = e["start"][at]
            return pa.Table.from_batches([_sent(_by(
                _place_of(e["doc"][at], places), doc=e["doc"][at], key=e["key"][at], start=start,
                end=start + length))])
        until = np.cumsum(np.fromiter(map(len, e["text"]), np.int64, len(e["text"])))
        part = (until - 1) // shard_bytes
        shards = []
        for a, b in _ranges(_groups(part)):
            shard = _Shard({k: v[a:b] for k, v in e.items()}, length)
            for other in shards:
                shard.meet(other)
            shards.append(shard)
        # What a later shard brought an earlier one has to reach those between them as well.
        for i, shard in enumerate(shards):
            for other in shards[i + 1:]:
                shard.meet(other)
        found = [s.repeats() for s in shards]
        out = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        return pa.Table.from_batches([_sent(_by(_place_of(out["doc"], places), **out))])
    return resolved


def _finished(docs: pa.Table, found: pa.Table) -> pa.Table:
    """Documents of a group without their repeats."""
    out = {name: [] for name in _ROW.names}
    for doc_id, key, raw, f in _documents(_unpacked(docs), found):
        start, end = (f[k] if len(f["doc"]) else np.zeros(0, np.int64) for k in ("start", "end"))
        mask = _mask(len(raw), start, end)
        a, b = _spans(mask)
        row = (doc_id, key, len(raw), int(mask.sum()), len(a),
               hashlib.sha256(raw[~mask].tobytes()).hexdigest(),
               np.column_stack([a, b]).ravel().tolist())
        for name, value in zip(_ROW.names, row):
            out[name].append(value)
    return pa.table(out, schema=_ROW)


def _without_repeats(schema: pa.Schema):
    """Rows of a group with what is left of their texts. Removed runs end at whole characters:
    bytes of a character that stays in part stay."""
    def cleaned(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = _unpacked(docs)
        if rows is None:
            return schema.empty_table()
        texts = []
        for (_, _, raw, f), old in zip(_documents(rows, found), rows.column("text")):
            if not len(f["doc"]):
                texts.append(old.as_py())
                continue
            gone = _mask(len(raw), f["start"], f["end"])
            inner = np.append((raw & 0xC0) == 0x80, False)
            for a, b in zip(*_spans(gone)):
                while a < b and inner[a]:
                    gone[a] = False
                    a += 1
                while b > a and inner[b]:
                    b -= 1
                    gone[b] = False
            texts.append(raw[~gone].tobytes().decode("utf-8"))
        at = rows.schema.get_field_index("text")
        rows = rows.set_column(at, "text", pa.array(texts, pa.string()))
        if "n_chars" in rows.schema.names:
            rows = rows.set_column(
                rows.schema.get_field_index("n_chars"), "n_chars", pa.array(
                    [None if t is None else len(t) for t in texts], pa.int64()))
        return rows.cast(schema)
    return cleaned


def _found(docs: DataFrame, length: int, gram: int, shard_bytes: int, group_bytes: int,
           spread: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(rows packed by group, repeats packed by group)."""
    docs = bounded_batches(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = max(1, math.ceil(total / group_bytes))
    blob = "place int, blob binary"

    found = docs.select("doc_id", "text") \
        .mapInArrow(_anchor_entries(places, length, gram, shard_bytes, spread[0]), blob) \
        .groupBy("place").applyInArrow(_merge_bucket(places, spread[1]), blob)
    texts = docs.select("doc_id", "text") \
        .mapInArrow(_text_blobs(places, shard_bytes), blob)
    state = stored(texts.groupBy("place").cogroup(found.groupBy("place"))
                   .applyInArrow(_open_texts(places, length), blob), "repeats")
    settled = state.filter("place < 0").select((-1 - F.col("place")).alias("place"), "blob")
    opened = state.filter("place >= 0").groupBy("place") \
        .applyInArrow(_resolve(places, length, shard_bytes), blob)
    rows = docs.select("doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    return rows.mapInArrow(_text_blobs(places, shard_bytes), blob), settled.unionAll(opened)


def find_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                 shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES,
                 spread: tuple[int, int] = (SPREAD_SHARD, SPREAD_BUCKET)) -> DataFrame:
    """(doc_id, text_key, n_bytes, n_removed, n_spans, kept_sha256, removed) per row.

    ``removed`` holds the begin and end of each maximal removed run, in bytes of the UTF-8
    text, one after another. A null text is empty. A row without doc_id is neither changed nor
    compared. Rows with the same doc_id do not repeat each other; equal rows get equal results.
    ``text_key`` is a 32-bit hash of the text. Strings count as equal in step 2 when 88 bits of
    hashes (anchor and stretch, in one bucket) are, and those of spread anchors when 64 bits are.
    """
    rows, found = _found(docs.select("doc_id", "text"), length, gram, shard_bytes, group_bytes,
                         spread)
    return rows.groupBy("place").cogroup(found.groupBy("place")).applyInArrow(_finished, _RESULT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows without the runs that `find_repeats` finds; a column n_chars follows the text.

    Cuts lie between characters: of a character that a run holds in part nothing goes. No row
    is dropped; a text that was repeated as a whole is empty. Other columns stay as they are.
    """
    columns = docs.columns
    rows, found = _found(docs, length, gram, shard_bytes, group_bytes,
                         (SPREAD_SHARD, SPREAD_BUCKET))
    first = ["doc_id", "text"]
    schema = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).select(
        *first, *[c for c in columns if c not in first]).schema
    return rows.groupBy("place").cogroup(found.groupBy("place")).applyInArrow(
        _without_repeats(to_arrow_schema(schema)), schema).select(*columns)
