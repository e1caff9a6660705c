"""A compressed FM-index over many short texts: wavelet matrix over the Burrows-Wheeler transform, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_array(codes: np.ndarray, longest: int) -> np.ndarray:
    """The order of all suffixes of texts of at most `longest` codes that each end in a 0; suffixes end there, and equal ones keep their order."""
    n = len(codes)
    ends = np.flatnonzero(codes == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # codes up to the end of the text
    wide = int(codes.max()) >= 256
    bits, width = (21, 3) if wide else (8, 8)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([codes.astype(np.uint64), np.zeros(width, np.uint64)])
    for i in range(width):
        key |= np.where(left >= i, padded[i : i + n], np.uint64(0)) << np.uint64(bits * (width - 1 - i))
    order = np.argsort(key)
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    m = width
    rank = np.empty(n, np.int64)
    while True:
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order] = head
        tied = ~first
        tied[:-1] |= ~first[1:]
        at = np.flatnonzero(tied)
        if not len(at) or m > longest:
            break
        who = order[at]
        after = np.minimum(who + m, n - 1)
        pair = rank[who] * (n + 1) + np.where(left[who] >= m, rank[after] + 1, 0)
        by = np.argsort(pair)
        order[at] = who[by]
        pair = pair[by]
        first[at[1:]] |= pair[1:] != pair[:-1]
        m *= 2
    if len(at):
        who = order[at]
        order[at] = who[np.argsort(rank[who] * (n + 1) + who)]
    return order


class Bits:
    """A bit vector of n bits in n/64 words, with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.zeros = n - int(counts.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Index of texts given as codes from 1, each followed by a 0. `owner` names the document of each place."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, longest: int):
        order = suffix_array(codes, longest)
        n = len(codes)
        last = codes[order - 1]
        self.levels, self.depth = [], max(1, int(codes.max()).bit_length())
        seq = last.copy()
        for k in range(self.depth - 1, -1, -1):
            bit = (seq >> k) & 1
            self.levels.append(Bits(bit.astype(np.uint8)))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        sigma = 1 << self.depth
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))])
        self.shift = self.first[:sigma] - self._walk(np.arange(sigma), np.zeros(sigma, np.int64))
        self.owner = owner[order]
        change = np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1
        follow = np.searchsorted(change, np.arange(n), side="right")
        self.other = np.append(change, n)[follow]  # the next place with another owner
        self.n = n

    def _walk(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(i)
            i = np.where((code >> (self.depth - 1 - k)) & 1, level.zeros + ones, i - ones)
        return i

    def extend(self, text: np.ndarray, begin: np.ndarray, bound: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """How far each pattern reaches back from `begin` (not included) to `bound` while it stands in a document that is not `owner`:
        the first place of the longest such pattern of `text`."""
        at = begin.copy()
        lo, hi = np.zeros(len(begin), np.int64), np.full(len(begin), self.n, np.int64)
        live = np.flatnonzero(at > bound)
        while len(live):
            code = text[at[live] - 1]
            both = self._walk(np.tile(code, 2), np.concatenate([lo[live], hi[live]])) + np.tile(self.shift[code], 2)
            a, b = both[: len(live)], both[len(live) :]
            some = a < b
            safe = np.minimum(a, self.n - 1)
            good = some & ((self.owner[safe] != owner[live]) | (self.other[safe] < b))
            live = live[good]
            lo[live], hi[live] = a[good], b[good]
            at[live] -= 1
            live = live[at[live] > bound[live]]
        return at
