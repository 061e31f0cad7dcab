"""Suffix arrays by induced sorting, and permuted common prefixes, for the shards of `substrings`.

A string here is an integer array whose last symbol is its only smallest one.
Byte strings are scanned bucket by bucket in numpy; the reduced strings of the
recursion, with large alphabets and a third of the length or less, symbol by symbol.
"""

from __future__ import annotations

import numpy as np


def _smaller(s: np.ndarray) -> np.ndarray:
    """Of each suffix whether it is smaller than the next one (type S)."""
    n = len(s)
    differs = np.flatnonzero(s[:-1] != s[1:])
    out = np.zeros(n, bool)
    out[-1] = True
    if len(differs):
        rising = s[differs] < s[differs + 1]
        out[: differs[-1] + 1] = np.repeat(rising, np.diff(np.r_[-1, differs]))
    return out


class _Heads:
    """The next free place of each bucket, counted up (step 1) or down (step -1)."""

    def __init__(self, sa: np.ndarray, at: np.ndarray, step: int):
        self.sa, self.at, self.step = sa, at, step

    def put(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        n = np.bincount(symbols, minlength=len(self.at))
        ordered = symbols[order]
        rank = np.arange(len(order)) - (np.cumsum(n) - n)[ordered]
        self.sa[self.at[ordered] + self.step * rank] = suffixes[order]
        self.at += self.step * n


def _induce_wide(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """From the leftmost-smaller suffixes in order, all suffixes: larger ones left to right, smaller ones right to left."""
    n, buckets = len(s), len(sizes)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n_larger = np.bincount(s[~smaller], minlength=buckets)
    sa = np.empty(n, np.int64)
    lms_at = np.r_[0, np.cumsum(np.bincount(s[lms], minlength=buckets))]
    heads = _Heads(sa, starts.copy(), 1)
    for c in np.flatnonzero(sizes).tolist():
        now = sa[starts[c] : heads.at[c]]
        while len(now):
            now = now[now > 0] - 1
            now = now[~smaller[now]]
            symbols = s[now]
            heads.put(now, symbols)
            now = now[symbols == c]
        before = lms[lms_at[c] : lms_at[c + 1]]
        before = before[before > 0] - 1
        if len(before):
            heads.put(before, s[before])
    tails = _Heads(sa, ends - 1, -1)
    last = int(s[-1])
    tails.put(np.array([n - 1]), np.array([last]))
    for c in np.flatnonzero(sizes)[::-1].tolist():
        now = sa[tails.at[c] + 1 : ends[c]][::-1]
        while len(now):
            now = now[now > 0] - 1
            now = now[smaller[now]]
            symbols = s[now]
            tails.put(now, symbols)
            now = now[symbols == c]
        now = sa[starts[c] : starts[c] + n_larger[c]][::-1]
        now = now[now > 0] - 1
        now = now[smaller[now]]
        if len(now):
            tails.put(now, s[now])
    return sa


def _induce_narrow(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, symbol by symbol. The symbol before each place is looked up once: -1 if that suffix is of the other type, at place 0, and at -1 (a free place)."""
    n = len(s)
    ends = np.cumsum(sizes)
    before = np.full((2, n + 1), -1, np.int64)
    before[0, 1:n][~smaller[:-1]] = s[:-1][~smaller[:-1]]
    before[1, 1:n][smaller[:-1]] = s[:-1][smaller[:-1]]
    larger_before, smaller_before = before.tolist()
    seed = s[lms]
    n_seed = np.bincount(seed, minlength=len(sizes))
    start = np.full(n, -1, np.int64)  # leftmost-smaller suffixes at the ends of their buckets
    start[(ends - np.cumsum(n_seed))[seed] + np.arange(len(lms))] = lms
    sa = start.tolist()
    head = (ends - sizes).tolist()
    for p in sa:  # the list grows rightwards of the place being read
        c = larger_before[p]
        if c >= 0:
            sa[head[c]] = p - 1
            head[c] += 1
    tail = (ends - 1).tolist()
    for p in reversed(sa):
        c = smaller_before[p]
        if c >= 0:
            sa[tail[c]] = p - 1
            tail[c] -= 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _equal_substrings(s: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether s[a:a+length] equals s[b:b+length]."""
    same = np.ones(len(a), bool)
    live = np.arange(len(a))
    off = 0
    while len(live):
        live = live[length[live] > off]
        equal = s[a[live] + off] == s[b[live] + off]
        same[live[~equal]] = False
        live = live[equal]
        off += 1
    return same


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of `s` in order."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = _smaller(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    sizes = np.bincount(s)
    induce = _induce_wide if len(sizes) <= 256 < n else _induce_narrow
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    rough = induce(s, smaller, by_symbol, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]  # by leftmost-smaller substring
    place = np.empty(n, np.int64)
    place[lms] = np.arange(len(lms))
    length = np.diff(np.r_[lms, n]) + 1
    length[-1] = 1
    own = length[place[ordered]]
    same = np.zeros(len(lms), bool)
    alike = np.flatnonzero(own[1:] == own[:-1]) + 1
    same[alike] = _equal_substrings(s, ordered[alike - 1], ordered[alike], own[alike])
    names = np.cumsum(~same) - 1
    if len(lms) and names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[place[ordered]] = names
        ordered = lms[suffix_array(reduced)]
    return induce(s, smaller, ordered, sizes)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """For each start the length that its suffix shares with the suffix before it in `sa`, at most `room`.

    `s` has one byte a symbol. Starts whose predecessors agree as well (T[i-1] = T[phi(i)-1])
    have one less than the start before them, so only the other starts are compared.
    """
    n = len(s)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    at = np.arange(n)
    fresh = (at == 0) | (phi <= 0) | (s[at - 1] != s[phi - 1])
    fresh[1:] |= room[1:] > room[:-1]
    start = np.flatnonzero(fresh)
    shared = np.zeros(len(start), np.int64)
    live = np.flatnonzero(phi[start] >= 0)
    padded = np.r_[s, np.zeros(8, np.uint8)]
    words = np.ndarray(n + 1, np.uint64, padded.data, strides=(1,))
    while len(live):
        a, b = start[live] + shared[live], phi[start[live]] + shared[live]
        inside = (b < n) & (shared[live] < room[start[live]])
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        whole = x == 0
        shared[live] += np.where(whole, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8).astype(np.int64)
        live = live[whole]
    shared = np.minimum(shared, room[start])
    last = np.cumsum(fresh) - 1
    return np.clip(shared[last] - (at - start[last]), 0, room)
