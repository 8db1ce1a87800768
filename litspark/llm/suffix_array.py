"""Suffix arrays by induced sorting, and capped permuted longest common prefixes.

``suffix_array`` sorts a byte-like alphabet: suffixes are classified (S or L), the leftmost-smaller (LMS) substrings are
sorted by induction and named, the string of names is sorted, and the whole array is induced from it.  On a small
alphabet each induction step handles a whole bucket at once with numpy, and a string of few names is sorted by recursion;
one of many names by doubling their ranks, which numpy does faster than Python scans an induction.
"""

from __future__ import annotations

import numpy as np

SMALL = 1024  # alphabets up to this size are induced bucket by bucket


def classify(s: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than the next one.  The last symbol is the unique least one."""
    starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    values = s[starts]
    kinds = np.append(values[:-1] < values[1:], True)
    return np.repeat(kinds, np.diff(np.append(starts, len(s))))


def _lms(kind: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(kind[1:] & ~kind[:-1]) + 1).astype(np.int32)


def _groups(chars: np.ndarray, k: int):
    """Stable order by symbol, the rank inside each symbol's group, and the group sizes."""
    order = np.argsort(chars.astype(np.uint16) if k <= 1 << 16 else chars, kind="stable")  # 16 bits: a radix sort
    sizes = np.bincount(chars, minlength=k)
    rank = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order, rank, sizes


def _induce_buckets(s, kind, lms, k):
    n = len(s)
    sizes = np.bincount(s, minlength=k)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    sa = np.full(n, -1, np.int32)
    order, rank, counts = _groups(s[lms], k)
    ranked = s[lms][order]
    sa[(ends - counts)[ranked] + rank] = lms[order]
    filled = heads.copy()

    def push_left(at):
        at = at[at > 0] - 1
        at = at[~kind[at]]
        if len(at):
            order, rank, counts = _groups(s[at], k)
            sa[filled[s[at][order]] + rank] = at[order]
            np.add(filled, counts, out=filled)

    for c in range(k):
        if not sizes[c]:
            continue
        done = heads[c]
        while done < filled[c]:
            upto = filled[c]
            push_left(sa[done:upto])
            done = upto
        if counts[c]:
            push_left(sa[ends[c] - counts[c] : ends[c]])

    left = filled.copy()  # ends of the L-type parts
    filled = ends.copy()

    def push_right(at):
        at = at[at > 0] - 1
        at = at[kind[at]]
        if len(at):
            order, rank, counts = _groups(s[at], k)
            sa[filled[s[at][order]] - 1 - rank] = at[order]
            np.subtract(filled, counts, out=filled)

    last = sa[0]
    for c in range(k - 1, -1, -1):
        if not sizes[c]:
            continue
        done = ends[c]
        while filled[c] < done:
            upto = filled[c]
            push_right(sa[upto:done][::-1])
            done = upto
        push_right(sa[heads[c] : left[c]][::-1])
    sa[0] = last
    return sa


def _order_names(s: np.ndarray) -> np.ndarray:
    """Sorted suffix starts of a string of names, of an alphabet as large as itself: names are ranked by doubling, and in
    each round only those still equal."""
    m = len(s)
    sizes = np.bincount(s)
    rank = (np.cumsum(sizes) - sizes)[s]  # where the group of equals begins in the sorted order
    equal, step = np.flatnonzero(sizes[s] > 1), 1
    while len(equal):
        after = equal + step
        key = rank[equal] * (m + 1) + np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], equal[order]
        group = np.flatnonzero(np.concatenate(([True], rank[at][1:] != rank[at][:-1])))
        part = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(part, len(key)))
        shift = np.repeat(part, length) - np.repeat(group, np.diff(np.append(group, len(key))))
        rank[at] = rank[at] + shift
        equal = np.sort(at[np.repeat(length > 1, length)])
        step *= 2
    out = np.empty(m, np.int64)
    out[rank] = np.arange(m)
    return out


def _names(s, lms, ordered):
    """Names of the LMS substrings, in text order, by comparing neighbours of their sorted order."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    alive = np.flatnonzero(same)
    step = 0
    while len(alive):
        equal = s[a[alive] + step] == s[b[alive] + step]
        same[alive[~equal]] = False
        step += 1
        alive = alive[equal]
        alive = alive[length[a[alive]] > step]
    name = np.empty(len(s), np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms]


def _sort(s: np.ndarray, k: int) -> np.ndarray:
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    if k > SMALL:
        return _order_names(s)
    kind = classify(s)
    lms = _lms(kind)
    rough = _induce_buckets(s, kind, lms, k)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names = _names(s, lms, ordered)
    top = int(names.max()) + 1
    if top == len(lms):
        order = np.empty(top, np.int64)
        order[names] = np.arange(top)
    else:
        order = _sort(names, top)
    return _induce_buckets(s, kind, lms[order], k)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Sorted suffix starts of a string of small non-negative integers (a sentinel is added and dropped)."""
    s = np.append(symbols.astype(np.int32) + 1, np.int32(0))  # a shard is far shorter than 2**31
    if len(s) == 1:
        return np.empty(0, np.int64)
    return _sort(s, int(s.max()) + 1)[1:]


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes a and b, up to room, by 8-byte steps of those still equal."""
    out = np.zeros(len(a), np.int64)
    alive, done = np.flatnonzero(room > 0), 0
    while len(alive):
        x, y = words[a[alive] + done], words[b[alive] + done]
        stop = x != y
        diff = (x ^ y)[stop]
        low = diff & (~diff + np.uint64(1))
        out[alive[stop]] = done + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~stop]
        done += 8
        over = room[alive] <= done
        out[alive[over]] = done
        alive = alive[~over]
    return np.minimum(out, room)


def capped_plcp(text: np.ndarray, sa: np.ndarray, cap: int):
    """phi (each suffix's predecessor in the array, -1 for the first) and PLCP in text order, counted up to cap.

    Only irreducible values are compared: where the symbols before a suffix and before its predecessor are equal, its
    value is its left neighbour's less one.  A stretch of those is one comparison, of at most its length and cap."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    buffer = np.zeros(n + 16, np.uint8)
    buffer[:n] = text
    words = np.ndarray((n + 8,), np.dtype("<u8"), buffer=buffer, strides=(1,))
    first = np.ones(n, bool)  # irreducible
    if n > 1:
        first[1:] = (phi[1:] < 1) | (phi[1:] != phi[:-1] + 1) | (text[:-1] != text[np.maximum(phi[1:], 1) - 1])
    heads = np.flatnonzero(first)
    sizes = np.diff(np.append(heads, n))
    known = phi[heads] >= 0
    room = np.where(known, np.minimum(n - np.maximum(heads, phi[heads]), sizes + cap - 1), 0)
    value = _common(words, heads, np.maximum(phi[heads], 0), room)
    plcp = np.repeat(value, sizes) - (np.arange(n) - np.repeat(heads, sizes))
    return phi, np.clip(plcp, 0, cap).astype(np.int32)
