"""A run-length index of many short strings: run-compressed Burrows-Wheeler transform with sampled run ends.

Each string ends in a terminator of its own, smaller than all bytes and ordered as the strings are. Of the
suffix array only the samples at run ends are kept: for the suffix at the head of a run its predecessor
in suffix order (the end of the run before) and the length of their match. Within a run the match of a
suffix with its predecessor is that of the suffix one byte before, moved by one and one shorter; so the
samples give, streaming over the text, the matching statistic of every position against the rest of the
collection: how long the match with its predecessor is, and where that lies.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the first sort of the suffixes looks at; each later one looks at twice as many.
FIRST = 7


class RunLengthIndex:
    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        """data: the strings' bytes, one after another; lengths: theirs, all under 32 * FIRST."""
        if len(lengths) and lengths.max() >= 32 * FIRST:
            raise ValueError("strings are too long for the depth of the sorts")
        self.n = len(data) + len(lengths)  # with terminators
        ends = np.cumsum(lengths + 1) - 1
        self.starts = ends - lengths
        self.of = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.symbols = np.zeros(self.n, np.int16)  # 0: terminator
        inside = np.ones(self.n, bool)
        inside[ends] = False
        self.symbols[inside] = data.astype(np.int16) + 1
        self.left = ends[self.of] - np.arange(self.n)  # bytes to the terminator
        self._build()

    @staticmethod
    def _heads(s: np.ndarray) -> np.ndarray:
        """Which elements of a sorted array differ from the one before."""
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        return new

    def _build(self) -> None:
        key = np.zeros(self.n, np.int64)
        padded = np.concatenate([self.symbols.astype(np.int64), np.zeros(FIRST, np.int64)])
        for j in range(FIRST):
            key = key * 257 + np.where(self.left > j, padded[j : j + self.n], 0)
        short = self.left < FIRST
        # suffixes that end within these bytes and look alike differ in their terminators
        own = np.where(short, self.of + 1, 0)
        order = np.lexsort((own, key))
        new = self._heads(key[order]) | self._heads(own[order])
        rank = np.empty(self.n, np.int64)  # how many suffixes are smaller, by the bytes looked at so far
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(self.n), 0))
        self.ranks = [(FIRST, rank)]
        tied = order[~(new & np.append(new[1:], True))]
        h = FIRST
        while len(tied):
            far = self.left[tied] >= h
            key = rank[tied] * (self.n + 1) + np.where(far, rank[np.where(far, tied + h, 0)] + 1, 0)
            order = np.argsort(key)
            tied, key = tied[order], key[order]
            old, place = rank[tied], np.arange(len(tied))
            group = np.maximum.accumulate(np.where(self._heads(old), place, 0))
            new = self._heads(key)
            rank = rank.copy()
            rank[tied] = old + np.maximum.accumulate(np.where(new, place, 0)) - group
            tied = tied[~(new & np.append(new[1:], True))]
            h *= 2
            self.ranks.append((h, rank))
        sa = np.empty(self.n, np.int64)
        sa[rank] = np.arange(self.n)
        first = self.left == (self.left[self.starts][self.of])  # of its string
        before = np.where(first[sa], -1, self.symbols[sa - 1])  # the transform
        head = np.ones(self.n, bool)
        head[1:] = (before[1:] != before[:-1]) | (before[1:] < 0)
        at = np.flatnonzero(head)
        self.runs = len(at)
        self.sample = np.zeros(self.n, bool)
        self.sample[sa[at]] = True
        self.sampled_before = np.full(self.n, -1, np.int64)
        self.sampled_before[sa[at[1:]]] = sa[at[1:] - 1]
        self.sampled_length = np.zeros(self.n, np.int64)
        self.sampled_length[sa[at[1:]]] = self._match(sa[at[1:]], sa[at[1:] - 1])
        del self.ranks

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes."""
        l = np.zeros(len(a), np.int64)
        for h, rank in reversed(self.ranks):
            x, y = np.minimum(a + l, self.n - 1), np.minimum(b + l, self.n - 1)
            l += h * ((rank[x] == rank[y]) & (x != y))
        for _ in range(FIRST - 1):
            x, y = np.minimum(a + l, self.n - 1), np.minimum(b + l, self.n - 1)
            l += (self.symbols[x] == self.symbols[y]) & (self.symbols[x] > 0)
        return l

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position (length of the match with the suffix's predecessor, where that is; -1: none)."""
        here = np.arange(self.n)
        last = np.maximum.accumulate(np.where(self.sample, here, 0))
        moved = here - last
        before = self.sampled_before[last]
        return np.maximum(self.sampled_length[last] - moved, 0), np.where(before >= 0, before + moved, -1)

    def repeats(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of every window of so many bytes that also starts earlier in the collection."""
        match, before = self.statistics()
        long_ = match >= length
        up = np.where(long_, before, np.arange(self.n))
        while True:
            above = up[up]
            if np.array_equal(above, up):
                break
            up = above
        least = np.arange(self.n)
        np.minimum.at(least, up, np.arange(self.n))
        at = np.flatnonzero((np.arange(self.n) != least[up]) & (self.left >= length))
        return self.of[at], at - self.starts[self.of[at]]
