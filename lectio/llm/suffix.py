"""Suffix arrays by induced sorting, and permuted common prefixes.

(Nong, Zhang, Chan: Two Efficient Algorithms for Linear Time Suffix Array Construction, 2011; Karkkainen, Manzini,
Puglisi: Permuted Longest-Common-Prefix Array, 2009.) Suffixes are classified as smaller or larger than their right
neighbour. The leftmost-smaller substrings are sorted by inducing from their first bytes, named by rank, and the string
of names is sorted by recursion; from the order of the leftmost-smaller suffixes one pass each from the left and from
the right induces all others. On bytes, a bucket is induced by array operations at once; the names, of which there are
too many for that, are classified, counted and named by array operations and induced by a loop.
"""

from __future__ import annotations

import numpy as np


def smaller(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour. t ends in a sentinel smaller than all else."""
    n = len(t)
    differs = np.empty(n, np.int64)
    differs[-1] = n - 1
    differs[:-1] = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    at = np.minimum.accumulate(differs[::-1])[::-1]  # the next place where t changes
    out = t[at] < t[np.minimum(at + 1, n - 1)]
    out[at == n - 1] = False
    out[-1] = True
    return out


def leftmost(is_s: np.ndarray) -> np.ndarray:
    """Places where a smaller suffix follows a larger one."""
    return np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1


def _place(sa: np.ndarray, head: np.ndarray, of: np.ndarray, letters: np.ndarray, step: int) -> None:
    """Puts the suffixes at the heads of their letters' buckets, in the order given."""
    order = np.argsort(letters, kind="stable")
    of, letters = of[order], letters[order]
    first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    count = np.diff(np.append(first, len(letters)))
    within = np.arange(len(letters)) - np.repeat(first, count)
    sa[head[letters] + step * within] = of
    head[letters[first]] += step * count


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array that the order of lms gives."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    size = np.bincount(t, minlength=letters)
    end = np.cumsum(size)
    begin = end - size
    tail = end - 1
    _place(sa, tail, lms[::-1], t[lms[::-1]], -1)  # at the ends of the buckets, tail: before the first of them
    head = begin.copy()

    def larger(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[~is_s[j]]
        if len(j):
            _place(sa, head, j, t[j], 1)

    used = np.flatnonzero(size)
    for c in used:
        at = begin[c]
        while at < head[c]:
            batch, at = sa[at : head[c]].copy(), head[c]
            larger(batch)
        larger(sa[tail[c] + 1 : end[c]])
    for c in used:
        sa[tail[c] + 1 : end[c]] = -1
    tail = end - 1

    def lesser(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[is_s[j]]
        if len(j):
            _place(sa, tail, j, t[j], -1)

    sa[0] = n - 1  # the sentinel is a bucket of its own, and smaller than nothing
    for c in used[::-1]:
        if c == 0:
            continue
        at = end[c] - 1
        while at > tail[c]:
            batch, at = sa[tail[c] + 1 : at + 1][::-1].copy(), tail[c]
            lesser(batch)
        lesser(sa[begin[c] : head[c]][::-1])
    return sa


def _names(t: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """A name by rank for each leftmost-smaller substring, in the order of the text; how many names there are."""
    ends = np.empty(len(t), np.int64)
    ends[lms] = np.append(lms[1:], len(t) - 1)  # substrings go up to the next one's first letter
    a, b = order[:-1], order[1:]
    same = (ends[a] - a) == (ends[b] - b)
    active, step = np.flatnonzero(same), 0
    while len(active):
        u, v = a[active] + step, b[active] + step
        equal = t[u] == t[v]
        same[active[~equal]] = False
        active = active[equal & (u < ends[a[active]])]
        step += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.empty(len(t), np.int64)
    name[order] = rank
    return name[lms], int(rank[-1]) + 1


def _sorted_names(t: np.ndarray, letters: int) -> np.ndarray:
    """The suffix array of a string of names that ends in its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    is_s = smaller(t)
    lms = leftmost(is_s)
    size = np.bincount(t, minlength=letters)
    end = np.cumsum(size)
    s = t.tolist()
    # the suffix to the left, if it is a larger one (a smaller one); nothing for what is not there yet (-1)
    before = np.arange(-1, n)
    before[0] = before[n] = -1
    larger, lesser = before.copy(), before.copy()
    larger[1:n][is_s[:-1]] = -1
    lesser[1:n][~is_s[:-1]] = -1
    larger, lesser = larger.tolist(), lesser.tolist()

    def induced(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        _place(sa, end - 1, order[::-1], t[order[::-1]], -1)
        sa = sa.tolist()
        head = (end - size).tolist()
        for i in sa:
            j = larger[i]
            if j >= 0:
                c = s[j]
                at = head[c]
                sa[at] = j
                head[c] = at + 1
        tail = (end - 1).tolist()
        for i in reversed(sa):
            j = lesser[i]
            if j >= 0:
                c = s[j]
                at = tail[c]
                sa[at] = j
                tail[c] = at - 1
        return np.array(sa, np.int64)

    sa = induced(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names, k = _names(t, order, lms)
    if k < len(lms):
        order = lms[_sorted_names(names, k)]
    return induced(order)


def suffix_array(data: bytes) -> np.ndarray:
    """Where the suffixes of data start, in their order."""
    t = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int16) + 1, [0]]).astype(np.int16)
    is_s = smaller(t)
    lms = leftmost(is_s)
    if len(t) == 1:
        return np.zeros(0, np.int64)
    sa = _induce(t, is_s, lms, 257)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    names, n = _names(t, order, lms)
    if n < len(lms):
        order = lms[_sorted_names(names, n)]
    return _induce(t, is_s, order, 257)[1:]


#: Prefixes are measured at every so many places first, of which the others follow but for the last few bytes
STEPS = (64, 8, 1)


def permuted_prefixes(data: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, by its place in the text: the length of the prefix, up to `most`, that it has in common with the one
    before it in the suffix array; 0 for the first. From one place to the next it falls by one at most. Eight bytes a step."""
    n = len(data)
    octets = np.frombuffer(data + bytes(most + 16), np.uint8)
    eight = np.ndarray((n + most + 8,), "<u8", octets.tobytes(), strides=(1,)).copy()
    out, other = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    other[sa[1:]] = sa[:-1]
    known = 0
    for step in STEPS:
        at = np.arange(0, n, step)
        if known:
            at = at[at % known != 0]
        at = at[other[at] >= 0]
        k = np.maximum(out[at - at % known] - at % known, 0) if known else np.zeros(len(at), np.int64)
        v = other[at]
        u = at
        while len(u):
            x = eight[u + k] ^ eight[v + k]
            equal = x == 0
            low = x[~equal] & (~x[~equal] + np.uint64(1))  # the lowest bit that differs
            out[u[~equal]] = k[~equal] + (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            u, v, k = u[equal], v[equal], k[equal] + 8
            over = k >= most
            out[u[over]] = most
            u, v, k = u[~over], v[~over], k[~over]
        out[at] = np.minimum(out[at], np.minimum(most, n - np.maximum(at, other[at])))
        known = step
    return out
