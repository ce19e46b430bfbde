"""Periodic runs: maximal pairs of a bottom-up LCP-interval tree.

Words become numbers, the suffixes of many texts are sorted together by prefix doubling
(numpy), and only positions whose first ``core`` words stand a second time in
their text go on.  Bottom-up over the LCP intervals, children are united small
into large.  A node keeps its positions sorted, and again sorted within the class of
their left word.  Two positions of different children with different left words
are a maximal pair: the match of the interval's depth extends to neither side.
With distance q and depth l the pair covers l + q words of period q, so pairs with
``l + q >= max(min_words, min_exponent * q)`` are the runs, without any extension.
Multiples of a run's smallest period give the same stretch and are dropped there.

Only pairs near each other qualify (q at most l / (min_exponent - 1)).  Occurrences of one match that near are
equally spaced and all but the first have the same left word, so all partners of
a position are found with two binary searches: work grows with the positions and
the pairs that qualify, not with all pairs.

Edge cases: a null, empty or blank text has no words and no runs; rows are independent, so
repeated rows and ids count each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import batched, records, utf8

WORDS_PER_BATCH = 1 << 17
_NONE = -1


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """The words as numbers, no number used by two texts, and after each text a number of its own."""
    out, base = [], 0
    for words in texts:
        number = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
        out += map(number.__getitem__, words)
        base += len(number)
        out.append(base)
        base += 1
    return np.asarray(out, np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted key: where each row's group starts, and whether it has several rows."""
    head = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    single = head & np.concatenate([head[1:], [True]])
    return start, ~single


def sorted_repeats(ids: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, lcp with the one before) of the suffixes that share ``core`` words with another.

    Suffixes without such a neighbour are left out; where a new group of at least ``core`` common
    words begins, the lcp is 0.
    """
    order = np.argsort(ids, kind="stable")
    start, several = _groups(ids[order])
    rank = np.empty(len(ids), np.int64)
    rank[order] = start
    todo = order[several]
    levels, h = [(1, rank.astype(np.int32))], 1
    held = None
    while len(todo):
        if held is None and 2 * h > core:
            # common prefixes of 'core' words: two overlapping stretches of h words
            key = rank[todo] * len(ids) + rank[todo + core - h]
            todo = todo[np.argsort(key, kind="stable")]
            _, several = _groups(np.sort(key, kind="stable"))
            held = todo = todo[several]
            if not len(todo):
                break
            # the groups of rank may have been thinned out; order within them stands
            todo = todo[np.argsort(rank[todo], kind="stable")]
        key = rank[todo] * len(ids) + rank[todo + h]
        by = np.argsort(key, kind="stable")
        todo, key = todo[by], key[by]
        old, _ = _groups(rank[todo])
        start, several = _groups(key)
        rank = rank.copy()
        rank[todo] += start - old
        todo = todo[several]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
    if held is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = held[np.argsort(rank[held], kind="stable")]
    a, b = places[:-1].copy(), places[1:].copy()
    lcp = np.zeros(len(places), np.int64)
    for h, at in reversed(levels):
        same = at[a] == at[b]
        lcp[1:] += h * same
        a += h * same
        b += h * same
    lcp[lcp < core] = 0
    return places, lcp


class _Node:
    """Positions of an LCP interval, sorted; and sorted within the class of their left word."""

    __slots__ = ("places", "classes")

    def __init__(self, place: int, left: int):
        self.places, self.classes = [place], {left: [place]}

    def absorb(self, other: "_Node") -> None:
        _merge(self.places, other.places)
        for left, places in other.classes.items():
            held = self.classes.setdefault(left, [])
            _merge(held, places)


def _merge(into: list[int], places: list[int]) -> None:
    if not into or places[0] > into[-1]:
        into += places
    elif len(places) * 16 < len(into):
        for x in places:
            insort(into, x)
    else:
        into += places
        into.sort()


class PairFinder:
    """Maximal pairs (start, period, length) whose distance meets the length constraints."""

    def __init__(self, left: np.ndarray, min_words: int, min_exponent: int):
        self.left, self.min_words, self.min_exponent = left, min_words, min_exponent
        self.found: dict[tuple[int, int], int] = {}

    def walk(self, places: np.ndarray, lcp: np.ndarray) -> dict[tuple[int, int], int]:
        """{(start, length): smallest period} over all LCP intervals, deepest first."""
        depth: list[int] = []
        nodes: list[_Node] = []
        node = None
        lefts = self.left[places].tolist()
        for place, left, l in zip(places.tolist(), lefts, lcp.tolist()):
            while depth and depth[-1] > l:
                node = self._unite(nodes.pop(), node, depth.pop())
            if l and depth and depth[-1] == l:
                nodes[-1] = self._unite(nodes[-1], node, l)
            elif l:
                depth.append(l)
                nodes.append(node)
            node = _Node(place, left)
        while depth:
            node = self._unite(nodes.pop(), node, depth.pop())
        return self.found

    def _unite(self, a: _Node, b: _Node, l: int) -> _Node:
        """Report the pairs between two children of an interval of depth ``l`` and unite them."""
        if len(a.places) < len(b.places):
            a, b = b, a
        reach = l // (self.min_exponent - 1)
        nearest = max(1, self.min_words - l)
        if nearest <= reach:
            all_, classes, found = a.places, a.classes, self.found
            for left, places in b.classes.items():
                for i in places:
                    # after i: the nearest place's class holds every place within reach
                    at = bisect_right(all_, i)
                    if at < len(all_) and all_[at] - i <= reach:
                        other = int(self.left[all_[at]])
                        if other != left:
                            held = classes[other]
                            for j in held[bisect_left(held, i + nearest):bisect_right(held, i + reach)]:
                                self._keep(found, i, j - i, l)
                    # before i: only the first of the equally spaced places can have another left word
                    at = bisect_left(all_, i - reach)
                    if at < len(all_) and all_[at] <= i - nearest and self.left[all_[at]] != left:
                        self._keep(found, all_[at], i - all_[at], l)
        a.absorb(b)
        return a

    @staticmethod
    def _keep(found: dict, start: int, period: int, l: int) -> None:
        key = (start, l + period)
        if found.get(key, period) >= period:
            found[key] = period


def runs_of(texts: list[list[bytes]], min_words: int = 24, min_exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids = _numbered(texts)
    # a run of n >= max(min_words, e * q) words is a pair of depth n - q, at least this
    core = -(-min_words * (min_exponent - 1) // min_exponent)
    places, lcp = sorted_repeats(ids, core)
    if not len(places):
        return out
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = ends - [len(t) + 1 for t in texts]
    # a text's first word has a left word of its own, as each text ends in a number of its own
    left = np.concatenate([[_NONE], ids[:-1]])
    found = PairFinder(left, min_words, min_exponent).walk(places, lcp)
    if found:
        first = np.asarray([s for s, _ in found], np.int64)
        for (start, length), period, t in zip(found, found.values(), np.searchsorted(ends, first, "right").tolist()):
            out[t].append((start - int(starts[t]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that stand in a run behind its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def periodic_runs(docs: DataFrame, min_words: int = 24, min_exponent: int = 3) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), best, collapsed per row of ``docs`` (doc_id, text).

    Words are stretches without ASCII white space.  A run is a stretch of words of smallest period q with
    at least ``max(min_words, min_exponent * q)`` words that no neighbouring word extends.  ``best`` is the run of
    greatest length / period, ``collapsed`` the text without the words behind a run's first period, joined by a space.
    """
    if min_exponent < 3 or min_words < min_exponent:
        raise ValueError("min_exponent must be 3 or more, min_words at least min_exponent")
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("best", run_type),
                        ("collapsed", pa.binary())])

    def named(run):
        return run and dict(zip(("start", "length", "period"), run))

    def solved(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
        for doc_id, words, runs in zip(ids, texts, runs_of(texts, min_words, min_exponent)):
            yield doc_id, len(words), [named(r) for r in runs], named(strongest(runs)), b" ".join(collapsed(words, runs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        ids, texts, size = [], [], 0
        for doc_id, text in records(batches):
            words = (text or b"").split()
            if size and size + len(words) > WORDS_PER_BATCH:
                yield from solved(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(words)
            size += len(words) + 1
        if ids:
            yield from solved(ids, texts)

    fields = "start: long, length: long, period: long"
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
            .mapInArrow(lambda batches: batched(rows(batches), schema, weigh=4),
                        f"doc_id long, n_words long, runs array<struct<{fields}>>, best struct<{fields}>, collapsed binary")
            .withColumn("collapsed", F.col("collapsed").cast("string")))
