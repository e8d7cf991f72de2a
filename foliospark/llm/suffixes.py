"""Suffix arrays in NumPy by Larsson-Sadakane refinement, their common prefixes, and search."""

from __future__ import annotations

import numpy as np

from foliospark.llm.texts import eight_bytes


def suffix_array(symbols: np.ndarray, ends: np.ndarray, depth: int,
                 width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first ``depth`` places at least. A symbol spans
    ``width`` places from its own on.

    ``ends``: for each place where its text ends; a suffix that ends sooner comes first.
    Ranks start at 1 and are equal for suffixes that agree in the compared symbols. Each
    round doubles the compared length and sorts only groups that still hold several suffixes,
    by the rank of what follows.
    """
    n = len(symbols)
    rank = np.zeros(n, np.int64)
    if not n:
        return np.zeros(0, np.int64), rank
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    head = np.ones(n, dtype=bool)
    head[1:] = sorted_symbols[1:] != sorted_symbols[:-1]
    rank[order] = _first_places(head) + 1
    done = width
    slots = np.flatnonzero(_in_groups(head))         # places of the order in unsorted groups
    while done < depth and len(slots):
        suffix = order[slots]
        after = suffix + done
        key = rank[suffix] * np.int64(n + 1)
        inside = after < ends[suffix]
        key[inside] += rank[after[inside]]
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        head = np.ones(len(slots), dtype=bool)
        head[1:] = key[1:] != key[:-1]
        rank[suffix] = slots[_first_places(head)] + 1
        slots = slots[_in_groups(head)]
        done *= 2
    return order, rank


def _first_places(head: np.ndarray) -> np.ndarray:
    """For each place the place where its group begins."""
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


def _in_groups(head: np.ndarray) -> np.ndarray:
    """Which places belong to groups of two or more."""
    return ~(head & np.append(head[1:], True))


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix of the order shares with the one before it, ``limit`` at most:
    Kasai's common prefixes, for all neighbours at once, eight bytes at a time."""
    view = eight_bytes(data)
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    left = np.arange(len(common))
    for at in range(0, limit, 8):
        there = np.minimum(order + at, len(data))
        differ = view[there[left]] ^ view[there[left + 1]]
        same = differ == 0
        with np.errstate(over="ignore"):
            low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // 8
        common[left] = at + np.where(same, 8, low)
        left = left[same]
        if not len(left):
            break
    return np.minimum(common, limit)


def search(symbols: np.ndarray, ends: np.ndarray, order: np.ndarray, queries: np.ndarray,
           lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of the order whose suffixes begin with it.

    ``queries``: one row of symbols for each query, of which the first ``lengths`` count. All
    queries bisect together.
    """
    bounds = []
    for upper in (False, True):
        low = np.zeros(len(queries), np.int64)
        high = np.full(len(queries), len(order), np.int64)
        left = np.flatnonzero(low < high)
        while len(left):
            mid = (low[left] + high[left]) // 2
            above = _above(symbols, ends, order[mid], queries, lengths, left, upper)
            high[left[above]] = mid[above]
            low[left[~above]] = mid[~above] + 1
            left = left[low[left] < high[left]]
        bounds.append(low)
    return bounds[0], bounds[1]


def _above(symbols, ends, suffix, queries, lengths, rows, upper) -> np.ndarray:
    """Whether each suffix is above its query; one that begins with it is not below it for the
    lower bound and not above it for the upper one."""
    out = np.full(len(rows), not upper)
    left = np.arange(len(rows))
    for k in range(queries.shape[1]):
        left = left[lengths[rows[left]] > k]
        if not len(left):
            break
        at = suffix[left] + k
        there = at < ends[suffix[left]]
        have = symbols[np.minimum(at, len(symbols) - 1)]
        want = queries[rows[left], k]
        out[left[~there | (have < want)]] = False
        out[left[there & (have > want)]] = True
        left = left[there & (have == want)]
    return out


def expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place of every range."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(int(size.sum())) + np.repeat(low - np.cumsum(size) + size, size)
