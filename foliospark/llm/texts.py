"""Whole texts of an Arrow batch as one byte array, worked on with NumPy.

Texts are read as UTF-8 bytes; a null text counts as empty. Words are runs of bytes of a
class; they are hashed eight bytes at a time to 64 bits, so two different words of one table
are taken for equal with a chance of about ``words ** 2 / 2 ** 65``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that a task turns into arrays at a time. One longer text is one piece.
PIECE_BYTES = 1 << 20

_BYTE = np.arange(256)
#: [^\x20\x09-\x0D]
BLANK_SPLIT = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM_SPLIT = (((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A))
               | (_BYTE >= 0x80))
#: A-Z to a-z, all else as it is.
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_K1 = np.uint64(0x9E3779B97F4A7C15)
_K2 = np.uint64(0xBF58476D1CE4E5B9)
_K3 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2 ** 64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose every output bit depends on all input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """For each position the eight bytes from there on, zeros behind the end."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:len(data)] = data
    return np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


class Texts:
    """Some rows' texts: ``data`` and the offsets where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


class Words:
    """Words of some texts: byte ranges, hashes, and the first word of each text."""

    def __init__(self, starts, ends, first, hashes):
        self.starts, self.ends, self.first, self.hashes = starts, ends, first, hashes

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) \
            if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64))
    at = np.frombuffer(offsets, np.int64, count=len(column) + 1, offset=8 * column.offset)
    return Texts(np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0])


def give_back() -> None:
    """Hands unused memory to the system. Workers live on from job to job, and what an earlier
    job's arrays left in their heaps would count beside the memory of the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of the GNU C library only
    if trim:
        trim(0)


def pieces(batch: pa.RecordBatch, column: str = "text",
           size: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a batch with at most ``size`` bytes of text, one row at least."""
    give_back()
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + size, "right")) - 1)
        lo, hi = texts.offsets[at], texts.offsets[to]
        yield batch.slice(at, to - at), Texts(texts.data[lo:hi], texts.offsets[at:to + 1] - lo)
        at = to


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    view = eight_bytes(data)
    left = (ends - starts).astype(np.int64)
    h = left.astype(np.uint64) * _K1
    active = np.arange(len(starts))
    at = starts.astype(np.int64)
    with np.errstate(over="ignore"):
        while len(active):
            chunk = view[at] & _MASKS[np.minimum(left, 8)]
            part = (h[active] ^ chunk) * _K2
            part ^= part >> np.uint64(29)
            h[active] = part * _K3
            more = left > 8
            active, at, left = active[more], at[more] + 8, left[more] - 8
        return mix(h)


def words_of(texts: Texts, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; a run ends with its text."""
    inside = is_word[texts.data]
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    edges = texts.offsets[1:-1]
    edges = edges[edges < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    goes_on = np.zeros(n, dtype=bool)
    goes_on[:-1] = before[1:] & inside[1:]
    ends = np.flatnonzero(inside & ~goes_on) + 1
    first = np.searchsorted(starts, texts.offsets)
    return Words(starts, ends, first, hashes_of(texts.data, starts, ends))


def windows_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a text of fewer words, but not none,
    gives the whole of it as one window."""
    counts = words.counts()
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(len(text)) + np.repeat(words.first[:-1] - np.cumsum(per_text) + per_text,
                                          per_text)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    length = np.minimum(counts, size)[text]
    h = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = np.where(i < length, (h + padded[at + i]) * _K2, h)
            h ^= h >> np.uint64(32)
        return mix(h), text


def bounded_batches(df: DataFrame, size: str = "16m") -> DataFrame:
    """The table, with its session told to close Arrow batches at ``size``: long texts then
    travel in batches of few rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def doc_crc(ids) -> np.ndarray:
    """crc32 of each id written as decimal text; null as -1."""
    import zlib
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) for i in ids], np.int64)
