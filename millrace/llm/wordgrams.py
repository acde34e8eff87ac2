"""Hashed word n-grams of many texts in one numpy pass.

Words are runs of letters, digits and underscores (\\w) of the lower-cased text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from millrace.llm.common import joined

_OTHER = re.compile(r"\W+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz0123456789_"]] = True
_IS_WORD[128:] = True


def plain(raw: bytes) -> bytes:
    """Lower case; in texts with other than ASCII characters, what divides words becomes a space."""
    return raw.lower() if raw.isascii() else _OTHER.sub(" ", raw.decode("utf-8", "replace").lower()).encode()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: All but white space: words as white space divides them.
SOLID = np.ones(256, bool)
SOLID[[0, 9, 10, 11, 12, 13, 32]] = False
_BASE = 0x5851F42D4C957F2D
_STEP = np.uint64(0xD1342543DE82EF95)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        out = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def hashed(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words, from their sums of bytes times powers of the base."""
    with np.errstate(over="ignore"):
        return _mixed(sums + lengths.astype(np.uint64))


def pieces(raw: bytes, words: int, most: int, inside: np.ndarray = _IS_WORD) -> Iterator[bytes]:
    """The text in pieces of about `most` bytes that end where words end; each begins with the last `words` words before it.

    So every run of up to words + 1 words lies in some piece. Memory grows with the longest words only.
    """
    if len(raw) <= most:
        yield raw
        return
    data = np.frombuffer(raw, np.uint8)
    before: list[bytes] = []
    a = 0
    while a < len(raw):
        b = min(a + most, len(raw))
        while b < len(raw) and inside[data[b]]:
            ends = np.flatnonzero(~inside[data[b : b + most]])
            b += int(ends[0]) if len(ends) else min(most, len(raw) - b)
        yield b" ".join([*before, raw[a:b]])
        edge = np.diff(inside[data[a:b]].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        found = [raw[a + i : a + j] for i, j in zip(np.flatnonzero(edge == 1)[-words:].tolist(), np.flatnonzero(edge == -1)[-words:].tolist(), strict=True)]
        before = [*before, *found][-words:]
        a = b


class WordStream:
    """Hashes of the whole words of one text that comes in parts, none empty, cut anywhere, also within words."""

    def __init__(self, inside: np.ndarray = _IS_WORD):
        self.inside = inside
        self.open: tuple[int, int] | None = None  # sum and length of a word that may go on

    def part(self, raw: bytes, last: bool) -> np.ndarray:
        w = Words([raw], self.inside)
        sums, lengths = w.sum, w.last - w.first
        if self.open is not None:
            held, size = self.open
            if self.inside[raw[0]]:
                first = (held + pow(_BASE, size, 1 << 64) * int(sums[0])) % (1 << 64), size + int(lengths[0])
                sums, lengths = sums[1:], lengths[1:]
            else:
                first = self.open
            sums = np.concatenate([np.array([first[0]], np.uint64), sums])
            lengths = np.concatenate([np.array([first[1]], np.int64), lengths])
            self.open = None
        if not last and self.inside[raw[-1]]:
            self.open = int(sums[-1]), int(lengths[-1])
            sums, lengths = sums[:-1], lengths[:-1]
        return hashed(sums, lengths)


class Words:
    """The words of several texts: where each starts and ends, its text, its hash. `inside`: the bytes that words are made of."""

    def __init__(self, held: list[bytes], inside: np.ndarray = _IS_WORD):
        self.data, self.starts, self.stops = joined(held)
        is_word = inside[self.data]
        edge = np.diff(is_word.view(np.int8), prepend=np.int8(0))
        self.first = np.flatnonzero(edge == 1)
        self.last = np.flatnonzero(edge == -1)
        self.of = np.searchsorted(self.starts, self.first, side="right") - 1
        up, down = _powers(1 << max(20, int(len(self.data)).bit_length()))
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(np.where(inside, _BYTE, 0).astype(np.uint64)[self.data] * up[: len(self.data)], out=total[1:])
            self.sum = (total[self.last] - total[self.first]) * down[self.first]
        self.hash = hashed(self.sum, self.last - self.first)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each n-gram that lies in one text, and its hash."""
        count = len(self.first) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = self.hash[:count].copy()
            for j in range(1, n):
                h = h * _STEP + self.hash[j : j + count]
            h = _mixed(h)
        at = np.flatnonzero(self.of[:count] == self.of[n - 1 : n - 1 + count])
        return at, h[at]

    def text(self, at: int, n: int) -> str:
        """The n words from `at`, one space between them."""
        return b" ".join(self.data[self.first[i] : self.last[i]].tobytes() for i in range(at, at + n)).decode("utf-8", "replace")
