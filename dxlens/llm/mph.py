"""Minimal perfect hash over 128-bit keys, vectorised in numpy.

Levels of bit arrays: at each level every remaining key hashes to one bit of an
array of ``gamma`` times as many bits; keys alone on their bit stay, the others
go on to the next level.  A key's slot is the rank of its bit, so ``n`` keys
occupy the slots ``0 .. n-1``.  The structure takes about three bits a key.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA = 1.7
MAX_LEVELS = 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the key (h1, h2) for one level (multiply-xorshift finaliser)."""
    with np.errstate(over="ignore"):
        x = h1 ^ (h2 * _ODD + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    def __init__(self, n: int, sizes: np.ndarray, words: np.ndarray, last: np.ndarray):
        self.n, self.sizes, self.words, self.last = n, sizes, words, last
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        counts = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "MinimalPerfectHash":
        """``h1``, ``h2``: uint64 halves of distinct keys."""
        n = len(h1)
        a, b = h1.astype(np.uint64), h2.astype(np.uint64)
        sizes, bits = [], []
        for level in range(MAX_LEVELS):
            if not len(a):
                break
            size = -(-max(64, int(GAMMA * len(a))) // 64) * 64
            at = (mix(a, b, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            clash = ~alone[at]
            a, b = a[clash], b[clash]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view(np.uint64) if bits else np.zeros(0, np.uint64)
        order = np.lexsort((b, a))
        last = np.stack([a[order], b[order]]) if len(a) else np.zeros((2, 0), np.uint64)
        return cls(n, np.asarray(sizes, np.int64), packed, last)

    def lookup(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where a key is certainly absent (others need a fingerprint test)."""
        a, b = h1.astype(np.uint64), h2.astype(np.uint64)
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mix(a[left], b[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot[left[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            left = left[~hit]
        if self.last.shape[1]:
            known = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(*self.last))}
            for i in left:
                slot[i] = known.get((int(a[i]), int(b[i])), -1 - self.ranks[-1]) + self.ranks[-1]
        return slot

    def to_arrays(self) -> dict[str, np.ndarray]:
        return {"n": np.asarray(self.n), "sizes": self.sizes, "words": self.words, "last": self.last}

    @classmethod
    def from_arrays(cls, arrays) -> "MinimalPerfectHash":
        return cls(int(arrays["n"]), arrays["sizes"], arrays["words"], arrays["last"])


def fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """32-bit fingerprint, independent of the slot hashes."""
    return (mix(h2.astype(np.uint64), h1.astype(np.uint64), 977) >> np.uint64(32)).astype(np.uint32)


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes):
    return np.load(io.BytesIO(data), allow_pickle=False)
