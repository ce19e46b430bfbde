"""FM-index over word numbers: a wavelet tree of the Burrows-Wheeler transform, in numpy.

Suffixes are sorted by their first ``length`` words only, which is all that
backward search for patterns up to that length needs.  Queries are vectors: many
intervals take a step at once.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Rank queries over a sequence of numbers below ``sigma``: one bit vector per binary digit, highest first."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.n = len(sequence)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        left = sequence.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bits = (left >> level & 1).astype(bool)
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bits, bitorder="little")
            packed[:len(raw)] = raw
            words = packed.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(self.n - bits.sum()))
            left = np.concatenate([left[~bits], left[bits]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place.

        The place moves down the levels with the symbol's digits; so does the start of
        the symbol's own run, and their distance at the bottom is the count.
        """
        start, place = np.zeros(len(symbols), np.int64), places.astype(np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = (symbols >> level & 1).astype(bool)
            s, p = self._ones(i, start), self._ones(i, place)
            start = np.where(one, self.zeros[i] + s, start - s)
            place = np.where(one, self.zeros[i] + p, place - p)
        return place - start

    def _ones(self, i: int, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        mask = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i][word] + np.bitwise_count(self.words[i][word] & mask).astype(np.int64)


def _ranked(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, dense ranks) of pairs; ``new`` marks where the sorted pairs change."""
    key = first * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)  # from 1; 0 stands for the end of the text
    return order, new, rank


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(rank), np.int64)
    if by < len(rank):
        out[:len(rank) - by] = rank[by:]
    return out


class FMIndex:
    """Index of a text of word numbers from 1 (0 separates passages) for patterns of up to ``length`` words."""

    def __init__(self, text: np.ndarray, length: int):
        self.length, n = length, len(text)
        text = text.astype(np.int64)
        sigma = int(text.max(initial=0)) + 1
        # ranks of the first 1, 2, 4, ... words, then of exactly ``length`` and ``length - 1``
        ranks, size = {1: text + 1}, 1
        while size * 2 <= length:
            ranks[size * 2] = _ranked(ranks[size], _ahead(ranks[size], size))[2]
            size *= 2

        def prefix(words: int) -> tuple[np.ndarray, np.ndarray]:
            return ranks[size], _ahead(ranks[size], words - size)

        key_a, key_b = prefix(length)
        order, new, _ = _ranked(key_a, key_b)
        self.suffixes = order
        a, b = prefix(length - 1) if length - 1 >= size else (ranks[size // 2], _ahead(ranks[size // 2], length - 1 - size // 2))
        a, b = a[order], b[order]
        shorter = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        # stretches of suffixes that share their first length - 1 words
        self.group = np.cumsum(shorter) - 1
        self.bounds = np.concatenate([np.flatnonzero(shorter), [n]])
        # the earliest text place of each stretch that shares all ``length`` words
        starts = np.flatnonzero(new)
        self.whole = np.cumsum(new) - 1
        self.earliest = np.minimum.reduceat(order, starts) if n else np.zeros(0, np.int64)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def extend(self, words: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with a word put before each."""
        ranks = self.tree.rank(np.concatenate([words, words]), np.concatenate([low, high]))
        return self.count[words] + ranks[:len(words)], self.count[words] + ranks[len(words):]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns of ``length`` words without their last word."""
        group = self.group[low]
        return self.bounds[group], self.bounds[group + 1]

    def first_occurrences(self, passages: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For every place of ``passages`` whose next ``length`` words lie in its passage: their earliest place in the text, else -1.

        Backward search from each passage's end, all passages in step: while the match is
        shorter than ``length`` a word is put before it; then the last word goes as the next comes,
        so each match statistic costs one step.
        """
        found = np.full(len(passages), -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        starts, ends = starts[order], (starts + sizes)[order]
        sizes = sizes[order]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.suffixes), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = int(np.searchsorted(-sizes, -step, side="right"))
            low, high = low[:live], high[:live]
            at = ends[:live] - step
            if step > self.length:
                held = high > low
                l, h = self.shorten(np.minimum(low, len(self.group) - 1))
                low, high = np.where(held, l, low), np.where(held, h, low)
            low, high = self.extend(passages[at], low, high)
            if step >= self.length:
                held = high > low
                found[at[held]] = self.earliest[self.whole[low[held]]]
        return found
