"""Token ids of whole texts, by the tokenizers library.

A text is cut at single blanks between two characters that are no white space. The byte-level
pre-tokeniser never lets a token cross such a blank (a blank opens the next token), so the ids
of the units, one after another, are the ids of the text; each distinct unit of a task is
encoded once. New units that begin and end at such blanks go to the tokenizer many at a time, as
one text; the bytes of the tokens tell where each unit ends.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np

from foliospark.llm.texts import Texts, hashes_of

#: Distinct units whose ids a task remembers before it starts over.
REMEMBERED = 1_000_000
#: Units that the tokenizer gets as one text.
JOINED = 256

_BYTE = np.arange(256)
_NO_BLANK = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D))
              | ((_BYTE >= 0x1C) & (_BYTE <= 0x1F)) | (_BYTE == 0x85))
#: First bytes of characters among which Unicode has white space.
_MAY_BE_BLANK = np.isin(_BYTE, [0xC2, 0xE1, 0xE2, 0xE3])
#: A sentence may end behind these.
_STOPS = np.isin(_BYTE, [ord(c) for c in ".!?\n"])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class Encoder:
    """Encodes texts in a task, with the tokenizer file at ``path`` on each executor. What it
    remembers is kept in NumPy arrays sorted by the units' hashes."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        # A character of a token stands for a byte, but in added tokens, which stand as they are.
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(added[i].encode()) if i in added else len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each hash stands or would stand, whether it is there)."""
        place = np.searchsorted(self.keys, hashes)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == hashes[there]
        return place, there

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of each one's ids)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(
            [u.decode("utf-8", "replace") for u in units], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum())), size

    def _encoded_joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`_encoded` of units that no token crosses wherever they follow each other. Where the
        bytes of the tokens do not add up to the units' (text that is not UTF-8), one by one."""
        ids, _ = self._encoded([b"".join(units[i:i + JOINED]) for i in range(0, len(units), JOINED)])
        through = np.cumsum(self.token_bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        last = np.searchsorted(through, ends)
        if len(units) and (through[-1] != ends[-1] or (through[last] != ends).any()):
            return self._encoded(units)
        return ids, np.diff(last, prepend=-1).astype(np.int32)

    def _learn(self, hashes: np.ndarray, place: np.ndarray, units: list[bytes], by: np.ndarray,
               joined: int) -> None:
        """``units`` are those of ``hashes[by]``; the first ``joined`` of them can be joined."""
        found, size = (np.concatenate(v) for v in zip(
            self._encoded_joined(units[:joined]), self._encoded(units[joined:])))
        total = len(found)
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used:self.used + total] = found
        back = np.argsort(by)
        at, size = (self.used + np.cumsum(size, dtype=np.int64) - size)[back], size[back]
        self.keys = np.insert(self.keys, place, hashes)
        self.at = np.insert(self.at, place, at)
        self.size = np.insert(self.size, place, size)
        self.used += total

    def encode(self, texts: Texts, end: int | None = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; where each text begins; places
        behind which a sentence ends)."""
        data, n = texts.data, len(texts.data)
        joins = np.zeros(n + 1, dtype=bool)
        if n > 2:
            plain = _NO_BLANK[data]
            inner = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
            at = np.flatnonzero(inner) + 1
            odd = _MAY_BE_BLANK[data[at + 1]]
            odd |= _MAY_BE_BLANK[data[np.maximum(at - 2, 0)]] & (data[at - 1] >= 0x80)
            odd |= _MAY_BE_BLANK[data[np.maximum(at - 3, 0)]] & (data[at - 1] >= 0x80)
            joins[at[~odd]] = True
        cut = joins.copy()
        cut[texts.offsets] = True
        cut[n] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n) if len(starts) else starts
        first = np.searchsorted(starts, texts.offsets)
        first[texts.offsets == n] = len(starts)

        hashes = hashes_of(data, starts, ends)
        values, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(values) > REMEMBERED:
            self.forget()
        place, there = self._places(values)
        if not there.all():
            raw, new = data.tobytes(), example[~there]
            joinable = joins[starts[new]] & joins[ends[new]]
            by = np.argsort(~joinable, kind="stable")
            new = new[by]
            self._learn(values[~there], place[~there],
                        [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())],
                        by, int(joinable.sum()))
            place = np.searchsorted(self.keys, values)
        unit = place[which]
        size = self.size[unit].astype(np.int64)
        room = 0 if end is None else 1
        through = np.append(0, np.cumsum(size))
        doc_starts = through[first] + room * np.arange(len(first))
        begin = through[:-1] + room * np.repeat(np.arange(len(texts)), np.diff(first))
        out = np.full(int(doc_starts[-1]), 0 if end is None else end, np.uint32)
        within = np.arange(int(through[-1]))
        source = within + np.repeat(self.at[unit] - through[:-1], size)
        out[within + np.repeat(begin - through[:-1], size)] = self.ids[source]
        stops = (begin + size)[_STOPS[data[ends - 1]]]
        return out, doc_starts, stops


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)
