"""Token ids in wavelet matrices: bit planes with rank and select, one file record per shard.

A plane holds one bit of every id; behind it the ids with a zero bit come first, those with a
one bit after them, each in their old order. The record of a shard is

    b"WVM1", a JSON header (length first): number of ids, of planes, zeros of each plane;
    the documents' ids, nulls and lengths; and the planes, packed and compressed with zstd.

Parquet carries the records, so that any store Spark can reach holds them.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import bounded_batches, pieces
from foliospark.llm.tokens import encoder, tokenizer_path

#: Ids after which a shard is closed; a shard holds whole documents.
SHARD_IDS = 1 << 20

_MAGIC = b"WVM1"
#: Bits between two entries of the rank directory.
_BLOCK = 512


class WaveletMatrix:
    """A sequence of ids, answered from its bit planes only."""

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray]):
        self.size, self.zeros, self.planes = size, zeros, planes
        self._ranks: list[np.ndarray] | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        width = max(1, int(ids.max(initial=0)).bit_length())
        ids = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes = [], []
        for bit in range(width - 1, -1, -1):
            ones = (ids >> ids.dtype.type(bit)) & ids.dtype.type(1) != 0
            low = ids[~ones]
            planes.append(np.packbits(ones))
            zeros.append(len(low))
            ids = np.concatenate([low, ids[ones]])
        return cls(len(ids), zeros, planes)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are put back from the last one up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ids = np.zeros(self.size, kind)
        for depth in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[depth], count=self.size).view(bool)
            above = np.empty_like(ids)
            split = self.zeros[depth]
            above[~ones] = ids[:split]
            above[ones] = ids[split:] | kind(1 << (len(self.planes) - 1 - depth))
            ids = above
        return ids

    def _rank1(self, depth: int, at: int) -> int:
        """Ones of a plane before a place."""
        if self._ranks is None:
            self._ranks = []
            for plane in self.planes:
                per_byte = np.bitwise_count(plane)
                pad = -len(per_byte) % (_BLOCK // 8)
                per_block = np.pad(per_byte, (0, pad)).reshape(-1, _BLOCK // 8).sum(1)
                self._ranks.append(np.concatenate([[0], np.cumsum(per_block)]))
        block = at // _BLOCK
        plane = self.planes[depth]
        whole = plane[block * (_BLOCK // 8):at // 8]
        rest = int(plane[at // 8]) >> (8 - at % 8) if at % 8 else 0
        return int(self._ranks[depth][block] + np.bitwise_count(whole).sum() + rest.bit_count())

    def _bit(self, depth: int, at: int) -> int:
        return int(self.planes[depth][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        value = 0
        for depth, zeros in enumerate(self.zeros):
            bit = self._bit(depth, at)
            ones = self._rank1(depth, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """The places that ``token`` has behind the last plane, of the first ``end`` ids."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for depth, zeros in enumerate(self.zeros):
            a, b = self._rank1(depth, low), self._rank1(depth, high)
            if token >> (len(self.planes) - 1 - depth) & 1:
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` stands among the first ``end`` ids."""
        low, high = self._range(token, end)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def _select(self, depth: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane, by bisection on rank."""
        low, high = 0, self.size
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(depth, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) ``token``."""
        low, high = self._range(token, self.size)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for depth in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - depth) & 1
            at = self._select(depth, bit, at - self.zeros[depth] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]


def to_record(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file record of one shard."""
    matrix = WaveletMatrix.build(ids)
    head = json.dumps({"ids": matrix.size, "zeros": matrix.zeros, "docs": len(doc_ids)}).encode()
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    body = b"".join([keys.tobytes(), np.array(lengths, "<i8").tobytes(), nulls.tobytes(),
                     *(p.tobytes() for p in matrix.planes)])
    packed = pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)
    return _MAGIC + struct.pack("<IQ", len(head), len(body)) + head + packed


def from_record(record: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(ids, document ids, lengths) of a record; the planes are all that is unpacked."""
    if record[:4] != _MAGIC:
        raise ValueError("not a wavelet matrix record")
    size, raw = struct.unpack_from("<IQ", record, 4)
    head = json.loads(record[16:16 + size])
    body = np.frombuffer(pa.Codec("zstd").decompress(record[16 + size:], raw, asbytes=True),
                         np.uint8)
    n, docs, at = head["ids"], head["docs"], 0
    keys = body[:8 * docs].view("<i8")
    lengths = body[8 * docs:16 * docs].view("<i8")
    at = 16 * docs + (docs + 7) // 8
    nulls = np.unpackbits(body[16 * docs:at], count=docs).astype(bool)
    step = (n + 7) // 8
    planes = [body[at + step * i:at + step * (i + 1)] for i in range(len(head["zeros"]))]
    doc_ids = [None if gone else int(k) for k, gone in zip(keys, nulls)]
    return WaveletMatrix(n, head["zeros"], planes), doc_ids, lengths


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt out by ranges of doc_id, each partition in order; equal ids stay
    together, their texts in order."""
    return bounded_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions(
        "doc_id", "text")


def encode_shards(docs: DataFrame, path: str | None = None, end: int = 0,
                  shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, seq, n_ids, record): one record for each shard, shards in the order of doc_id.

    A null text is an empty one (its end id only); a null doc_id comes first; rows with the
    same doc_id are all kept. No rows give no shards.
    """
    path = path or tokenizer_path()

    def shards(batches):
        part, seq, n = TaskContext.get().partitionId(), 0, 0
        ids, keys, lengths = [], [], []

        def close():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int64()),
                "n_ids": pa.array([n], pa.int64()),
                "record": pa.array([to_record(np.concatenate(ids), keys, lengths)], pa.binary())})

        for batch in batches:
            for rows, texts in pieces(batch):
                found, begin, _ = encoder(path).encode(texts, end)
                ids.append(found)
                keys += rows.column(0).to_pylist()
                lengths += np.diff(begin).tolist()
                n += len(found)
                if n >= shard_ids:
                    yield close()
                    seq, n, ids, keys, lengths = seq + 1, 0, [], [], []
        if keys:
            yield close()

    return in_order(docs).mapInArrow(shards, "part int, seq bigint, n_ids bigint, record binary")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the records alone.

    Only the totals of the parts are summed up in one place: one row for each partition that
    wrote; within a part its own shards are.
    """
    def documents(batches):
        for batch in batches:
            for part, seq, record in zip(*(batch.column(i).to_pylist() for i in range(3))):
                matrix, doc_ids, lengths = from_record(record)
                ids = matrix.decode().astype("<u4")
                to = np.cumsum(lengths)
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * n, pa.int32()),
                    "seq": pa.array([seq] * n, pa.int64()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "within": pa.array(to - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(ids[b - k:b]) for b, k in zip(to, lengths)],
                                          pa.int64())})

    read = bounded_batches(shards).select("part", "seq", "record").mapInArrow(
        documents, "part int, seq bigint, doc_id bigint, within bigint, n_tokens bigint, "
                   "ids_crc32 bigint")
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("s", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))) \
        .join(parts, "part").select("part", "seq", (F.col("s") + F.col("p")).alias("base"))
    return read.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
