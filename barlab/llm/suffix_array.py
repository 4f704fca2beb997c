"""Suffix arrays by induced sorting, vectorised bucket by bucket, and permuted common prefixes."""

from __future__ import annotations

from math import isqrt

import numpy as np

#: Names of a reduced string above this are written in two digits each.
ONE_DIGIT = 512


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as smaller than the empty one's
    neighbours, as ``s`` ends with its only smallest symbol."""
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    types = np.ones(n, bool)
    inside = following < n
    types[:-1][inside] = step[following[inside]] > 0
    return types


def _grouped(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the symbols in it, each one's place in its group, and the groups' sizes by symbol."""
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    counts = np.bincount(ranked)
    begins = np.cumsum(counts) - counts
    return order, ranked, np.arange(len(ranked)) - begins[ranked], counts


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The array that the leftmost-smaller suffixes ``lms``, in their order, induce: first the larger-type suffixes in
    buckets from the left, then the smaller-type ones from the right."""
    ends = np.cumsum(sizes)
    heads, tails = (ends - sizes).copy(), ends.copy()
    out = np.full(len(s), -1, np.int64)
    symbols = s[lms]
    lms_order, _, _, lms_counts = _grouped(symbols)
    lms_by_symbol = np.split(lms[lms_order], np.cumsum(lms_counts)[:-1])

    def push_larger(found: np.ndarray) -> None:
        order, ranked, place, counts = _grouped(s[found])
        out[heads[ranked] + place] = found[order]
        heads[: len(counts)] += counts

    starts = heads.copy()
    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < heads[c]:  # suffixes of one run of a symbol follow each other
            before = out[done : heads[c]] - 1
            done = heads[c]
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                push_larger(before)
        if c < len(lms_by_symbol) and len(lms_by_symbol[c]):
            before = lms_by_symbol[c] - 1
            before = before[before >= 0]
            before = before[~smaller[before]]
            if len(before):
                push_larger(before)

    def push_smaller(found: np.ndarray) -> None:  # found in scan order, from the right
        order, ranked, place, counts = _grouped(s[found])
        out[tails[ranked] - 1 - place] = found[order]
        tails[: len(counts)] -= counts

    push_smaller(np.array([len(s) - 1]))
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c]
        while done > tails[c]:
            before = out[tails[c] : done][::-1] - 1
            done = tails[c]
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                push_smaller(before)
        before = out[starts[c] : heads[c]][::-1] - 1
        before = before[before >= 0]
        before = before[smaller[before]]
        if len(before):
            push_smaller(before)
    return out


def _ordered_names(names: np.ndarray, count: int) -> np.ndarray:
    """Suffix order of a reduced string, by the same sorting. Many names are written in two digits, so that buckets
    stay few; suffixes of names are then those at even places, and sort alike."""
    if count <= ONE_DIGIT:
        return suffix_array(names)
    base = isqrt(count - 1) + 1
    digits = np.zeros(2 * len(names) + 1, np.int64)
    digits[:-1:2], digits[1::2] = names // base + 1, names % base + 1
    order = suffix_array(digits)[1:]
    return order[order % 2 == 0] // 2


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of ``s``, whose last symbol is its only smallest; symbols are small non-negative integers."""
    n = len(s)
    if n <= 2:
        return np.arange(n)[::-1]
    if s.max() < 1 << 15:
        s = s.astype(np.int16)  # sorted by radix
    sizes = np.bincount(s)
    smaller = suffix_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) < 2:
        return induce(s, smaller, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = induce(s, smaller, lms, sizes)
    ordered = first[is_lms[first]]
    # A substring runs to the next leftmost-smaller place, that one included.
    length = np.ones(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    different = _differ(s, ordered[:-1], ordered[1:], length)
    names = np.empty(n, np.int64)
    names[ordered] = np.cumsum(np.concatenate([[0], different]))
    reduced = names[lms]
    count = int(reduced.max()) + 1
    if count == len(lms):
        order = np.argsort(reduced)
    else:
        order = _ordered_names(reduced, count)
    return induce(s, smaller, lms[order], sizes)


def _differ(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the substrings at ``a`` and ``b`` differ, symbol by symbol while any pair is undecided."""
    differ = length[a] != length[b]
    open_ = np.flatnonzero(~differ)
    step = 0
    while len(open_):
        unequal = s[a[open_] + step] != s[b[open_] + step]
        differ[open_[unequal]] = True
        step += 1
        open_ = open_[~unequal]
        open_ = open_[length[a[open_]] > step]
    return differ


def permuted_prefixes(data: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """``at``: places of ``data`` (uint8) in suffix order; ``room``: bytes from each place of ``data`` to the end of its
    piece. By place: the length of the prefix that a place of ``at`` shares with the one before it there, within both
    pieces; 0 for the first and for places that ``at`` lacks."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)).view("<u8").ravel()
    out = np.zeros(len(data), np.int32)
    left, right = at[:-1], at[1:]
    most = np.minimum(room[left], room[right])
    open_, step = np.arange(len(right)), 0
    while len(open_):
        differ = words[left[open_] + step] ^ words[right[open_] + step]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        out[right[open_]] = np.minimum(step + same, most[open_])
        step += 8
        open_ = open_[(same == 8) & (most[open_] > step)]
    return out
