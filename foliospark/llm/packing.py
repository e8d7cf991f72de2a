"""Sequences of at most ``window`` tokens, cut in the order of the documents.

A window may end behind a document (free), behind a sentence (``sentence_cost``), or within a
long sentence (``inside_cost``); what a window lacks to its padded length
costs one for each token. Windows are padded to ``window`` ids, but one whose length is a
power of two stays as it is. The cheapest cuts of a run of documents come from dynamic
programming:

    best(j) = cost of cutting at j + min over i of best(i) + padding(j - i)

For i within a window of j, ``best(i) - (j - i)`` has its minimum at the head of a monotone
queue of ``best(i) + i``; the powers of two are looked at one by one.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foliospark.llm.texts import pieces
from foliospark.llm.tokens import encoder, tokenizer_path
from foliospark.llm.wavelet import in_order

WINDOW = 1024
#: Padding tokens that a cut is worth.
SENTENCE_COST = 2
INSIDE_COST = 8
#: Ids between two places where a sentence may be cut.
INSIDE_STEP = 32
#: Ids after which a task packs what it has; the last window of a run may be padded.
RUN_IDS = 1 << 20

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def cuts(ends: np.ndarray, stops: np.ndarray, window: int = WINDOW,
         sentence_cost: int = SENTENCE_COST, inside_cost: int = INSIDE_COST,
         inside_step: int = INSIDE_STEP) -> np.ndarray:
    """The cheapest window borders, 0 and the last end included.

    ``ends``: places behind the documents, ascending; ``stops``: those behind sentences.
    """
    total = int(ends[-1])
    borders = np.union1d(np.append(ends, 0), stops[(stops > 0) & (stops < total)])
    # A long sentence gets places of its own, every ``inside_step`` ids.
    more = (np.diff(borders) - 1) // inside_step
    nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
    inner = np.repeat(borders[:-1], more) + nth * inside_step
    places = np.union1d(borders, inner)
    cost = np.where(np.isin(places, ends), 0, sentence_cost)
    cost[np.isin(places, inner)] = inside_cost
    cost[0] = 0

    # Earlier places at a distance of a power of two.
    number = np.full(total + 1, -1, np.int32)
    number[places] = np.arange(len(places))
    earlier: dict[int, list[int]] = {}
    step = 1
    while step <= window:
        far = np.flatnonzero(places >= step)
        before = number[places[far] - step]
        for j, i in zip(far[before >= 0].tolist(), before[before >= 0].tolist()):
            earlier.setdefault(j, []).append(i)
        step *= 2

    at, extra = places.tolist(), cost.tolist()
    best = [0] * len(at)
    came = [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])     # (best(i) + place(i), i), ascending
    for j in range(1, len(at)):
        here = at[j]
        while at[queue[0][1]] < here - window:
            queue.popleft()
        value, i = queue[0]
        value += window - here
        for k in earlier.get(j, ()):
            if best[k] < value:
                value, i = best[k], k
        best[j] = value = value + extra[j]
        came[j] = i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = came[j]
    return np.array([0, *out[::-1]], np.int64)


def pack_run(keys: list, begin: np.ndarray, ids: np.ndarray, stops: np.ndarray, first: int,
             **options) -> tuple[pa.RecordBatch, int]:
    """Pieces of one run of documents, and the number of its sequences."""
    borders = cuts(begin[1:], stops, **options)
    edges = np.union1d(borders, begin)
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(begin, start, "right") - 1
    sequence = np.searchsorted(borders, start, "right") - 1
    ids = ids.astype("<u4")
    crc = [zlib.crc32(ids[a:b]) for a, b in zip(start.tolist(), end.tolist())]
    names = [k.split()[0] for k in SCHEMA.split(", ")]
    values = [pa.array(keys, pa.int64()).take(pa.array(doc)), start - begin[doc], end - start, crc,
              np.diff(begin)[doc], first + sequence, start - borders[sequence]]
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.int64())
                                       for v in values], names=names), len(borders) - 1


def pack(docs: DataFrame, path: str | None = None, end: int = 0, window: int = WINDOW,
         run_ids: int = RUN_IDS, **options) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A document's ids are those of its text (null: empty) and ``end``. Documents are packed in
    the order of doc_id, nulls first, rows with equal ids in the order of their texts; each
    partition packs runs of about ``run_ids`` ids. ``sequence_id`` has the partition in its
    upper 32 bits. No rows give no pieces.
    """
    path = path or tokenizer_path()

    def packed(batches):
        first = TaskContext.get().partitionId() << 32
        ids, keys, sizes, stops, n = [], [], [], [], 0

        def flush():
            begin = np.append(0, np.cumsum(np.concatenate(sizes)))
            return pack_run(keys, begin, np.concatenate(ids), np.concatenate(stops), first,
                            window=window, **options)

        for batch in batches:
            for rows, texts in pieces(batch):
                found, begin, ended = encoder(path).encode(texts, end)
                ids.append(found)
                keys += rows.column(0).to_pylist()
                sizes.append(np.diff(begin))
                stops.append(ended + n)
                n += len(found)
                if n >= run_ids:
                    out, used = flush()
                    yield out
                    first += used
                    ids, keys, sizes, stops, n = [], [], [], [], 0
        if keys:
            yield flush()[0]

    return in_order(docs).mapInArrow(packed, SCHEMA)
