"""Benchmark passages in documents, found by searching suffix arrays of the documents.

Each shard (a few MB of whole documents) is sorted as one array of word suffixes; every suffix
of every benchmark item bisects it. An occurrence of ``WINDOW`` words, or of a shorter item as
a whole, is a match; occurrences that go on in both texts are one longer match.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.suffixes import expand, search, suffix_array
from foliospark.llm.texts import ALNUM_SPLIT, bounded_batches, pieces, texts_of, words_of

#: Words of a window.
WINDOW = 13
#: Text bytes of a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20
#: Benchmark text sent to the executors at a time; a larger benchmark goes in several blocks.
BLOCK_BYTES = 32 << 20

MATCH = "struct<item_id:bigint,item_start:bigint,start:bigint,length:bigint>"


def _windows(items: pa.Table, window: int) -> dict:
    """Distinct windows of some items, and where each stands in which item."""
    words = words_of(texts_of(items.column("text")).lower(), ALNUM_SPLIT)
    counts = words.counts()
    per_item = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
    item, place = expand(np.zeros(len(counts), np.int64), per_item)
    length = np.minimum(counts[item], window)
    padded = np.append(words.hashes, np.zeros(window, np.uint64))
    rows = padded[(words.first[:-1][item] + place)[:, None] + np.arange(window)]
    rows[np.arange(window) >= length[:, None]] = 0
    rows, which = np.unique(np.column_stack([length.astype(np.uint64), rows]), axis=0,
                            return_inverse=True) if len(rows) else (rows, item)
    by = np.argsort(which, kind="stable")
    ids = items.column("item_id")
    return {"queries": np.ascontiguousarray(rows[:, 1:]), "lengths": rows[:, 0].astype(np.int64),
            "first": np.searchsorted(which[by], np.arange(len(rows) + 1)), "row": item[by],
            "place": place[by], "ids": pc.fill_null(ids, 0).to_numpy(),
            "null": pc.is_null(ids).to_numpy(zero_copy_only=False)}


def _shard_matches(words, block: dict) -> tuple[np.ndarray, ...]:
    """(text, item row, place in the item, place in the text, length) of all matches."""
    ends = np.repeat(words.first[1:], words.counts())
    depth = block["queries"].shape[1]
    order, _ = suffix_array(words.hashes, ends, depth)
    low, high = search(words.hashes, ends, order, block["queries"], block["lengths"])
    query, slot = expand(low, high)
    at = order[slot]
    hit, pair = expand(block["first"][query], block["first"][query + 1])
    at, length = at[hit], block["lengths"][query[hit]]
    row, place = block["row"][pair], block["place"][pair]
    # Windows one behind the other in both texts are one match.
    by = np.lexsort([at, at - place, row])
    at, length, row, place = at[by], length[by], row[by], place[by]
    goes_on = np.zeros(len(at), dtype=bool)
    goes_on[1:] = ((row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1] + 1)
                   & (ends[at[1:]] == ends[at[:-1]]))
    head = np.flatnonzero(~goes_on)
    if not len(at):
        return (at,) * 5
    last = np.append(head[1:], len(at)) - 1
    text = np.searchsorted(words.first, at[head], "right") - 1
    return (text, row[head], place[head], at[head] - words.first[text],
            at[last] + length[last] - at[head])


def _covered(text: np.ndarray, start: np.ndarray, length: np.ndarray, texts: int) -> np.ndarray:
    """For each text how many places its ranges cover."""
    by = np.lexsort([start, text])
    text, start, end = text[by], start[by], (start + length)[by]
    total = np.zeros(texts, np.int64)
    if len(text):
        base = text * (int(end.max()) + 1)           # ranges of one text after another
        reach = np.maximum.accumulate(end + base)
        before = np.append(-1, reach[:-1])
        new = np.maximum(0, end + base - np.maximum(start + base, before))
        np.add.at(total, text, new)
    return total


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
                 carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``carry``, and n_words, n_hit and matches.

    ``matches`` holds the longest verbatim matches: (item_id, item_start, start, length), in
    words. ``n_hit`` counts document words inside any match. Null texts have no words; an item
    without words matches nothing; one with a null item_id is matched, with a null id. No
    documents give no rows, an empty benchmark no matches. Words count as equal when their
    64-bit hashes are.
    """
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text") \
        .filter("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    spark = docs.sparkSession
    found = bounded_batches(docs).select(F.struct(*carry).alias("row"), "text").withColumn(
        "matches", F.array().cast(f"array<{MATCH}>"))
    row = found.schema["row"].dataType.simpleString()

    for i in range(blocks):
        block = spark.sparkContext.broadcast(
            _windows(items.filter(part == i).toArrow().combine_chunks(), window))
        final = i == blocks - 1
        shape = f"row {row}, " + ("n_words bigint, n_hit bigint" if final else "text string") \
            + f", matches array<{MATCH}>"

        def matched(batches, block=block, final=final):
            b = block.value
            for batch in batches:
                for rows, texts in pieces(batch, size=shard_bytes):
                    yield _with_matches(rows, texts, b, final)

        found = found.mapInArrow(matched, shape)
    return found.select("row.*", "n_words", "n_hit", "matches")


def _with_matches(rows: pa.RecordBatch, texts, block: dict, final: bool) -> pa.RecordBatch:
    words = words_of(texts.lower(), ALNUM_SPLIT)
    text, row, place, start, length = _shard_matches(words, block)
    id_, gone = block["ids"][row], block["null"][row]
    old = rows.column(2)
    if len(old.flatten()):                            # from earlier blocks
        o = old.flatten()
        text = np.append(pc.list_parent_indices(old).to_numpy(), text)
        id_ = np.append(pc.fill_null(o.field("item_id"), 0).to_numpy(), id_)
        gone = np.append(pc.is_null(o.field("item_id")).to_numpy(zero_copy_only=False), gone)
        place, start, length = (np.append(o.field(f).to_numpy(), v) for f, v in (
            ("item_start", place), ("start", start), ("length", length)))
    by = np.lexsort([place, id_, length, start, text])
    values = pa.StructArray.from_arrays(
        [pa.array(id_[by], pa.int64(), mask=gone[by]), pa.array(place[by], pa.int64()),
         pa.array(start[by], pa.int64()), pa.array(length[by], pa.int64())],
        names=["item_id", "item_start", "start", "length"])
    n = len(rows)
    offsets = np.searchsorted(text[by], np.arange(n + 1)).astype(np.int32)
    matches = pa.ListArray.from_arrays(pa.array(offsets), values)
    if not final:
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), matches],
                                          names=["row", "text", "matches"])
    return pa.RecordBatch.from_arrays(
        [rows.column(0), pa.array(words.counts(), pa.int64()),
         pa.array(_covered(text, start, length, n), pa.int64()), matches],
        names=["row", "n_words", "n_hit", "matches"])


def is_contaminated() -> Column:
    """Matches cover a word, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): a document is
    contaminated when matches cover a word and at least a twentieth of its words."""
    ids = F.array_sort(F.array_distinct(F.transform(
        F.filter("matches", lambda m: m.item_id.isNotNull()),
        lambda m: m.item_id.cast("string"))))
    return find_matches(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", ids.alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows that are not contaminated, as they are."""
    columns = tuple(docs.columns)
    found = find_matches(docs, benchmark, window, carry=columns)
    # A document column may be called n_words or n_hit: the last ones are the counts.
    named = [f"_{i}" for i in range(len(columns))]
    return found.toDF(*named, "n_words", "n_hit", "matches").filter(~is_contaminated()) \
        .select(*[F.col(n).alias(c) for n, c in zip(named, columns)])
