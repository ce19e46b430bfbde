"""Words, their hashed subwords, and sparse bags of them; shared by the text classifiers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import utf8

BUCKETS = 1 << 18
LONG_SHARE = 32
GRAMS = (3, 4, 5)
TRIM = b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def held_out(column: str = "doc_id") -> F.Column:
    """Rows that may not be learned from: crc32 of the id as text leaves 2 modulo 4, or there is no id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text_hash, size in bytes and the given columns of the rows that may be learned from."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), *columns).where(~held_out())


def sample_order(max_bytes: int) -> list[F.Column]:
    """By a hash of the id; texts over 1 / LONG_SHARE of ``max_bytes`` after all others, the shortest first."""
    return [F.greatest("size", F.lit(max_bytes // LONG_SHARE)), F.xxhash64("doc_id"), F.col("doc_id"), F.col("text_hash")]


def fitting(sizes: Iterable[int], max_bytes: int) -> list[int]:
    """The numbers of the rows to take, in order: each that still fits, and the first one whatever its size."""
    taken, used = [], 0
    for i, size in enumerate(sizes):
        if not taken or used + size <= max_bytes:
            taken.append(i)
            used += size
    return taken


def texts_of(docs: DataFrame, keys: set[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
    """The text of each (doc_id, text_hash), once, however many rows have it."""
    if not keys:
        return {}
    chosen = docs.sparkSession.createDataFrame(sorted(keys), "doc_id long, text_hash long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    found = rows.join(F.broadcast(chosen), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return {(row["doc_id"], row["text_hash"]): bytes(row["text"] or b"") for row in found.toLocalIterator()}


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").decode("utf-8", "replace").lower().encode().split()


def subwords(words: list[bytes], chunk: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the buckets of each word's n-grams and of the word itself; ``starts`` marks each word's first.

    Words are worked off in chunks, so that the hashes in between stay small.
    """
    if len(words) <= chunk:
        return _subwords(words)
    parts = [_subwords(words[i:i + chunk]) for i in range(0, len(words), chunk)]
    shifts = np.cumsum([0, *(len(b) for b, _ in parts[:-1])])
    return np.concatenate([b for b, _ in parts]), np.concatenate([s + x for (_, s), x in zip(parts, shifts)])


def _subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"<" + (w.strip(TRIM) or w) + b">" for w in words]
    lengths = np.array([len(w) for w in marked])
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    room = np.repeat(first + lengths, lengths) - np.arange(len(data))  # bytes left in the word
    found, whose = [], []
    prime = np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        for n in GRAMS:
            at = np.flatnonzero(room >= n)
            h = np.full(len(at), 0xCBF29CE484222325 + n, np.uint64)
            for k in range(n):
                h = (h ^ data[at + k]) * prime
            found.append(h)
            whose.append(owner[at])
        power = np.cumprod(np.full(int(lengths.max(initial=1)), prime, np.uint64))
        place = np.arange(len(data)) - first[owner]
        found.append(np.add.reduceat((data + np.uint64(1)) * power[place] * prime, first) if len(words) else np.zeros(0, np.uint64))
        whose.append(np.arange(len(words)))
        h = np.concatenate(found)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    who = np.concatenate(whose)
    order = np.argsort(who, kind="stable")
    buckets = ((h ^ (h >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32)[order]
    return buckets, np.searchsorted(who[order], np.arange(len(words)))


class Bags:
    """A sparse matrix held in both orders, multiplied from either side."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int):
        self.rows, self.columns = rows, columns
        self.by_row = self._sorted(row, column, value)
        self.by_column = self._sorted(column, row, value)

    @staticmethod
    def _sorted(key, other, value):
        order = np.argsort(key, kind="stable")
        keys, starts = np.unique(key[order], return_index=True)
        return keys, starts, other[order].astype(np.int32), value[order]

    @staticmethod
    def _sums(side, dense: np.ndarray, size: int) -> np.ndarray:
        keys, starts, other, value = side
        out = np.zeros((size, dense.shape[1]), np.float32)
        for d in range(dense.shape[1] if len(keys) else 0):
            out[keys, d] = np.add.reduceat(np.ascontiguousarray(dense[:, d])[other] * value, starts)
        return out

    def forward(self, dense: np.ndarray) -> np.ndarray:
        return self._sums(self.by_row, dense, self.rows)

    def backward(self, dense: np.ndarray) -> np.ndarray:
        return self._sums(self.by_column, dense, self.columns)
