"""Suffix arrays by induced sorting, and permuted common prefixes, in vector steps.

A text is classified into L and S suffixes. Its leftmost S (LMS) substrings
are sorted by two induction passes, named, and the string of names is sorted
in turn; two more passes induce the order of all suffixes. An induction pass
walks the buckets of first characters in order. Within a bucket it takes
whole waves of suffixes: those there so far, then the ones these put into
the same bucket, and so on, so a wave is a handful of vector operations and
a run of one character costs as many waves as it is long.

The names of the reduced string are mostly as many as its characters, so its
buckets hold one suffix each and leave nothing to vectorise; it is sorted by
refining ranks of doubling lengths instead, as long as any are equal.
"""

from __future__ import annotations

import numpy as np

#: Largest alphabet that is sorted by induction.
BUCKETS = 4096


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes: smaller than the suffix after them. The empty suffix counts as smallest, so the last is L."""
    n = len(t)
    if n == 0:
        return np.zeros(0, bool)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    up[-1] = -1
    at = np.where(up != 0, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _scatter(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, where: np.ndarray, back: bool) -> None:
    """Puts `where` at the bucket heads (or, back, tails) of its characters, in order."""
    if not len(where):
        return
    order = np.argsort(chars, kind="stable")
    kinds = chars[order]
    cut = np.flatnonzero(np.concatenate(([True], kinds[1:] != kinds[:-1])))
    sizes = np.diff(np.append(cut, len(kinds)))
    inside = np.arange(len(kinds)) - np.repeat(cut, sizes)
    heads = at[kinds[cut]]
    sa[np.repeat(heads, sizes) + (-inside if back else inside)] = where[order]
    at[kinds[cut]] = heads + (-sizes if back else sizes)


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order (or, for their substrings, only by first character)."""
    n = len(t)
    ends = starts[1:]
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _scatter(sa, tails.copy(), t[lms[::-1]], lms[::-1], back=True)
    seeds = {}
    if len(lms):
        first = t[lms]
        cut = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        for c, part in zip(first[cut].tolist(), np.split(lms, cut[1:])):
            seeds[c] = part
    heads = starts[:-1].copy()
    used = np.unique(t).tolist()
    last = np.array([n - 1])  # follows the empty suffix, and is L
    _scatter(sa, heads, t[last], last, back=False)
    for c in used:
        done = starts[c]
        while done < heads[c]:
            wave, done = sa[done : heads[c]], int(heads[c])
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                _scatter(sa, heads, t[before], before, back=False)
        if c in seeds:
            before = seeds[c][seeds[c] > 0] - 1
            before = before[~small[before]]
            if len(before):
                _scatter(sa, heads, t[before], before, back=False)
    for c in reversed(used):
        # S suffixes fill the bucket from its end; the L suffixes below them are in place.
        taken = int(ends[c]) - 1
        while taken > tails[c]:
            wave, taken = sa[tails[c] + 1 : taken + 1][::-1], int(tails[c])
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                _scatter(sa, tails, t[before], before, back=True)
        wave = sa[starts[c] : heads[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            _scatter(sa, tails, t[before], before, back=True)
    return sa


def _names(t: np.ndarray, lms: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in `order`, equal for equal substrings."""
    a, b = order[:-1], order[1:]
    size = ends - lms
    place = np.zeros(len(t) + 1, np.int64)
    place[lms] = np.arange(len(lms))
    la, lb = size[place[a]], size[place[b]]
    same = la == lb
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live] + k, b[live] + k
        equal = t[x] == t[y]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (la[live] > k)]
    return np.concatenate(([0], np.cumsum(~same)))


def by_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array by ranks of prefixes of length 1, 2, 4, ...; only suffixes that are still tied are sorted again."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    rank = np.zeros(n, np.int64)
    fresh = np.concatenate(([True], t[order][1:] != t[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    k = 1
    edge = np.flatnonzero(np.append(fresh, True))
    sizes = np.diff(edge)
    tied = np.repeat(sizes > 1, sizes)
    slots = np.flatnonzero(tied)
    while len(slots):
        who = order[slots]
        after = who + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[who]
        by = np.lexsort((second, first)) if n >= 1 << 31 else np.argsort(first << 32 | second, kind="stable")
        who, first, second = who[by], first[by], second[by]
        order[slots] = who
        fresh = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(who)), 0))
        rank[who] = slots[lead]
        sizes = np.diff(np.flatnonzero(np.append(fresh, True)))
        slots = slots[np.repeat(sizes > 1, sizes)]
        k *= 2
    return order


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of `t` (non-negative integers) in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    top = int(t.max()) + 1
    if top > BUCKETS:
        return by_doubling(t)
    t = t.astype(np.uint16)
    small = classify(t)
    starts = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=top))))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induce(t, small, starts, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    guess = _induce(t, small, starts, lms[np.argsort(t[lms], kind="stable")])
    order = guess[is_lms[guess]]
    ends = np.append(lms[1:] + 1, n)
    # The last LMS substring runs to the end of the text, which no other one does.
    named = _names(t, lms, ends, order)
    if named[-1] + 1 < len(lms):
        reduced = np.zeros(n, np.int64)
        reduced[order] = named
        order = lms[suffix_array(reduced[lms])]
    return _induce(t, small, starts, order)


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): for each position the suffix before it in order (-1: none), and their common prefix, exact up to `most`.

    Where the characters before a suffix and its neighbour agree, the prefix is
    one shorter than at the position before, so only the other positions and
    `starts` are compared, eight characters at a time.
    """
    n = len(sa)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    raw = np.zeros(n + 16, t.dtype)
    raw[:n] = t
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    at = np.arange(n)
    own = np.ones(n, bool)
    inner = phi[1:] > 0
    own[1:] = ~inner | (t[at[1:] - 1] != t[np.maximum(phi[1:], 1) - 1]) | (phi[:-1] < 0)
    own[starts] = True
    plcp = np.zeros(n, np.int64)
    heads = np.flatnonzero(own & (phi >= 0))
    live, k = heads, 0
    while len(live) and k < most:
        x, y = live + k, phi[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        same = eight[x] == eight[y]
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        run = np.minimum(run, n - np.maximum(x, y))
        plcp[live] += run
        k += 8
        live = live[run == 8]
    lead = np.maximum.accumulate(np.where(own, at, 0))
    return phi, np.maximum(plcp[lead] - (at - lead), 0)
