"""Suffix sorting by the difference cover modulo 3, in numpy.

Suffixes that start at positions 1 and 2 modulo 3 are sorted by their triples;
triples get names in order, and where names repeat the string of names is
sorted the same way. The remaining suffixes are sorted by their first symbol
and the rank of the suffix after it, and merged with the others.
"""

from __future__ import annotations

import numpy as np


def names(columns: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Ranks of the rows of columns (equal rows, equal ranks), and how many ranks there are."""
    bits = [max(1, int(c.max()).bit_length()) for c in columns]
    if sum(bits) > 63:
        first, _ = names(columns[:2])
        return names([first, *columns[2:]])
    key = columns[0].astype(np.int64)
    for c, b in zip(columns[1:], bits[1:]):
        key = (key << b) | c
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
    out = np.empty(len(key), np.int64)
    out[order] = new
    return out, int(new[-1]) + 1


def suffix_ranks(t: np.ndarray) -> np.ndarray:
    """The rank of each suffix of t (symbols from 1 up; a shorter suffix comes first)."""
    n = len(t)
    if n < 8:
        order = sorted(range(n), key=lambda i: t[i:].tolist())
        out = np.empty(n, np.int64)
        out[order] = np.arange(n)
        return out
    padded = np.concatenate([t.astype(np.int64), np.zeros(6, np.int64)])
    m = n + (n % 3 == 1)  # so that the names of class 1 end with one that has a 0
    one, two = np.arange(1, m, 3), np.arange(2, m, 3)
    sample = np.concatenate([one, two])
    name, count = names([padded[sample], padded[sample + 1], padded[sample + 2]])
    if count < len(sample):
        name = suffix_ranks(name + 1)
    rank = np.zeros(m + 6, np.int64)
    rank[sample] = name + 1
    zero = np.arange(0, n, 3)
    key0, _ = names([padded[zero], rank[zero + 1]])
    order0 = zero[np.argsort(key0, kind="stable")]
    order12 = sample[np.argsort(name, kind="stable")]
    order12 = order12[order12 < n]
    # places of class 0 among class 1: symbol, then rank of the next; among class 2: two symbols, then rank of the one after
    big = np.int64(len(rank) + 1)
    wide = np.int64(int(padded.max()) + 1)
    by1 = lambda i: padded[i] * big + rank[i + 1]
    ones, twos = order12[order12 % 3 == 1], order12[order12 % 3 == 2]
    less1 = np.searchsorted(by1(ones), by1(order0), "left")
    pair = lambda i: padded[i] * wide + padded[i + 1]
    if float(wide) * float(wide) * float(big) < 9e18:
        by2 = lambda i: pair(i) * big + rank[i + 2]
        less2 = np.searchsorted(by2(twos), by2(order0), "left")
    else:
        both, _ = names([np.concatenate([pair(twos), pair(order0)]), np.concatenate([rank[twos + 2], rank[order0 + 2]])])
        less2 = np.searchsorted(both[: len(twos)], both[len(twos) :], "left")
    place0 = np.arange(len(order0)) + less1 + less2
    taken = np.zeros(n, bool)
    taken[place0] = True
    out = np.empty(n, np.int64)
    out[order0] = place0
    out[order12] = np.nonzero(~taken)[0]
    return out


def equal_prefixes(t: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class for each start, equal where the next ``length`` bytes of t are equal; t holds them for every start."""
    rank = suffix_ranks(t.astype(np.int64) + 1)[starts]
    order = np.argsort(rank, kind="stable")
    new = np.zeros(len(starts), np.int64)
    step = 1 << 16
    for k in range(1, len(order), step):  # adjacent suffixes, compared byte by byte
        a, b = starts[order[k - 1 : k - 1 + step]], starts[order[k : k + step]]
        a = a[: len(b)]
        differ = np.zeros(len(b), bool)
        for j in range(length):
            differ |= t[a + j] != t[b + j]
        new[k : k + len(b)] = differ
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(new)
    return out
