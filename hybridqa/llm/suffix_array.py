"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Published methods: G. Nong, S. Zhang, W. H. Chan, "Linear Suffix Array Construction by Almost Pure
Induced-Sorting" (2009); J. Karkkainen, G. Manzini, S. Puglisi, "Permuted Longest-Common-Prefix Array" (2009).
Buckets are worked off in waves of array operations: a wave induces at once all that the entries
found so far in a bucket induce.
"""

from __future__ import annotations

import numpy as np

#: Below so many places for each name the reduced text isn't bucket-sorted again but ranked by doubling.
CROWDED = 64


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (the end counts as smallest)."""
    n = len(t)
    up = np.zeros(n, bool)
    if n > 1:
        differs = np.flatnonzero(t[:-1] != t[1:])
        rises = np.zeros(n, bool)
        rises[differs] = t[differs] < t[differs + 1]
        following = np.searchsorted(differs, np.arange(n - 1), "left")
        inside = following < len(differs)
        up[:-1][inside] = rises[differs[following[inside]]]
    return up


def _induce(t: np.ndarray, up: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes induce, given in some order: first the larger, then the smaller suffixes."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    symbols = np.flatnonzero(np.diff(starts))
    # larger suffixes: bucket by bucket upwards, heads grow; seeds wait at the end of their bucket
    order = np.argsort(t[seeds], kind="stable")
    by_symbol = seeds[order]
    first = np.searchsorted(t[by_symbol], np.arange(len(starts)))
    head = starts[:-1].copy()

    def put_up(found: np.ndarray) -> None:
        if len(found):
            c = t[found]
            o = np.argsort(c, kind="stable")
            c, found = c[o], found[o]
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[new, len(c)])
            sa[head[c] + np.arange(len(c)) - np.repeat(new, size)] = found
            head[c[new]] += size

    def larger(of: np.ndarray) -> np.ndarray:
        before = of[of > 0] - 1
        return before[~up[before]]

    put_up(np.array([n - 1]))  # the end induces the last suffix, which is a larger one
    for c in symbols.tolist():
        done = starts[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            put_up(larger(wave))
        put_up(larger(by_symbol[first[c] : first[c + 1]]))
    # smaller suffixes: bucket by bucket downwards, tails grow to the left
    tail = starts[1:].copy()
    filled = head

    def put_down(found: np.ndarray) -> None:
        if len(found):
            c = t[found]
            o = np.argsort(c, kind="stable")
            c, found = c[o], found[o]
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[new, len(c)])
            sa[tail[c] - 1 - (np.arange(len(c)) - np.repeat(new, size))] = found
            tail[c[new]] -= size

    def smaller(of: np.ndarray) -> np.ndarray:
        before = of[of > 0] - 1
        return before[up[before]]

    for c in symbols[::-1].tolist():
        done = starts[c + 1]
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1]
            done = tail[c]
            put_down(smaller(wave))
        put_down(smaller(sa[starts[c] : filled[c]][::-1]))
    return sa


def _names(t: np.ndarray, seeds: np.ndarray, ends: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of the leftmost-smaller substring at each seed (in text order); equal substrings share it. ordered: indices of seeds, sorted by substring."""
    a, b = ordered[:-1], ordered[1:]
    length = ends - seeds
    differs = length[a] != length[b]
    left = np.flatnonzero(~differs)
    k = 0
    while len(left):
        at = t[seeds[a[left]] + k] != t[seeds[b[left]] + k]
        differs[left[at]] = True
        left = left[~at]
        k += 1
        left = left[length[a[left]] > k]
    # the substrings share their last symbol too, or one of them is the text's last
    same = np.flatnonzero(~differs)
    last = np.where(ends < len(t), t[np.minimum(ends, len(t) - 1)].astype(np.int64), -1)
    differs[same] = last[a[same]] != last[b[same]]
    names = np.empty(len(seeds), np.int64)
    names[ordered] = np.r_[0, np.cumsum(differs)] if len(ordered) else []
    return names


def _ranked_by_doubling(names: np.ndarray) -> np.ndarray:
    """The suffix array of a text of names."""
    n, rank, h = len(names), names.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - h] = rank[h:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.r_[0, np.cumsum(k[1:] != k[:-1])]
        rank, h = new, h * 2
        if rank[order[-1]] == n - 1 or h >= n:
            return order


def suffix_array(t: np.ndarray, kinds: int | None = None) -> np.ndarray:
    """Starts of the suffixes of a text of small non-negative integers, in order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    kinds = kinds or int(t.max()) + 1
    t = t.astype(np.uint16 if kinds < 65536 else np.int64)
    up = suffix_types(t)
    seeds = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    starts = np.r_[0, np.cumsum(np.bincount(t, minlength=kinds))]
    if len(seeds) > 1:
        place = np.full(n, -1, np.int64)
        place[seeds] = np.arange(len(seeds))
        ordered = place[_induce(t, up, starts, seeds)]
        ordered = ordered[ordered >= 0]
        names = _names(t, seeds, np.r_[seeds[1:], n], ordered)
        top = int(names.max()) + 1
        if top == len(seeds):
            order = ordered
        elif top * CROWDED <= len(seeds):
            order = suffix_array(names, top)
        else:
            order = _ranked_by_doubling(names)
        seeds = seeds[order]
    return _induce(t, up, starts, seeds)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp) in text order: the suffix before each one in the array (-1: none) and their common prefix, at most `most`.

    A place whose left neighbour has the same symbol before it in both suffixes has one less than its neighbour;
    only the other, irreducible ones are compared.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (phi[1:] > 0) & (t[:-1] == t[phi[1:] - 1])
    own = np.flatnonzero(~reducible & (phi >= 0))
    line = np.zeros(n + 16, np.uint8 if t.max(initial=0) < 256 else np.int64)
    line[:n] = t
    length = np.zeros(n, np.int64)
    live, k = own, 0
    step = 8 if line.dtype == np.uint8 else 1
    packed = np.lib.stride_tricks.sliding_window_view(line, 8).view(np.uint64)[:, 0] if step == 8 and line.flags.c_contiguous else None
    while len(live):
        if packed is not None:
            same = packed[np.minimum(live + k, len(packed) - 1)] == packed[np.minimum(phi[live] + k, len(packed) - 1)]
            same &= np.maximum(live, phi[live]) + k + step <= n
        else:
            same = (np.maximum(live, phi[live]) + k < n) & (line[np.minimum(live + k, n)] == line[np.minimum(phi[live] + k, n)])
        stop = live[~same]
        length[stop] = k
        live = live[same]
        k += step
    for _ in range(step - 1):  # the rest of a block in which they part
        more = own[np.maximum(own, phi[own]) + length[own] < n]
        more = more[line[more + length[more]] == line[phi[more] + length[more]]]
        length[more] += 1
    anchor = np.maximum.accumulate(np.where(reducible, -1, i))
    plcp = np.where(phi >= 0, np.maximum(0, length[anchor] - (i - anchor)), 0)
    return phi, np.minimum(plcp, most)
