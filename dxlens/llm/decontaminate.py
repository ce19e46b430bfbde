"""Benchmark decontamination by pigeonhole edit matching.

An item within ``e`` edits of a stretch of a document has, of its ``e + 1``
pieces, at least one that occurs there unchanged.  Items and documents are
normalised (lower-cased by Unicode rules, runs of ASCII white space as one space; bytes that are
not UTF-8 as U+FFFD); lengths, edits and places count bytes of the normalised text.  The pieces of a
bounded block of items form an Aho-Corasick automaton on the executors; the documents
stream through it, and each piece hit is verified by Myers' bit-parallel edit distance
between the whole item and the stretch of the document that the hit implies.
A larger benchmark is worked off block by block, each block in one pass.

Edge cases: null and empty items match nothing, null and empty texts hold nothing; an
item too short for ``e + 1`` pieces of ``min_piece`` bytes gets a smaller budget (0 at
least, so it is still found unchanged); repeated items and rows are matched each on their own; null ids are kept;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import batched, records, utf8

ERROR_RATE = 0.1
MIN_PIECE = 5
GRAM = 4
BLOCK_BYTES = 4 << 20

PAIR_FIELDS = "doc_id long, text_hash long, item_id long, distance long, start long, stop long, budget long"
PAIR_SCHEMA = pa.schema([(x.split(" ")[0], pa.int64()) for x in PAIR_FIELDS.split(", ")])


def normalise(text: bytes | None) -> bytes:
    text = text or b""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return b" ".join(lower.split())


def budget(length: int, error_rate: float, min_piece: int) -> int:
    """Edits allowed for an item of ``length`` bytes: its share, as far as pieces of ``min_piece`` bytes allow.

    With the defaults the share alone sets it: a tenth, in pieces of 9 bytes (5 for items of 10 bytes, none below).
    """
    return max(0, min(int(length * error_rate), length // min_piece - 1))


def pieces(item: bytes, errors: int) -> list[tuple[int, bytes]]:
    """(offset, piece): ``errors + 1`` pieces of near-equal length."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


def masks(item: bytes) -> dict[int, int]:
    """For each byte the set of its places in the item, as bits."""
    found: dict[int, int] = {}
    for i, c in enumerate(item):
        found[c] = found.get(c, 0) | 1 << i
    return found


def gram_codes(text: bytes) -> list[int]:
    """The text's stretches of GRAM bytes, as numbers."""
    letters = np.frombuffer(text, np.uint8).astype(np.uint32)
    n = max(0, len(letters) - GRAM + 1)
    return sum((letters[i:i + n] << np.uint32(8 * i) for i in range(GRAM)), np.zeros(n, np.uint32)).tolist()


def best_match(length: int, places: dict[int, int], text: bytes) -> tuple[int, int]:
    """(distance, end): the least edit distance of the item to any stretch of ``text``, and where the first such ends.

    Myers' recurrence: one bit per row of the distance table holds whether the
    entry below is one more (``up``) or one less (``down``); whole columns advance by word arithmetic
    on integers as wide as the item.
    """
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = length, 0
    for i, c in enumerate(text):
        eq = places.get(c, 0)
        through = eq | down
        carry = (((eq & up) + up) ^ up) | eq
        more = down | ~(carry | up) & full
        less = up & carry
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = more << 1 & full, less << 1 & full
        up = (less | ~(through | more)) & full
        down = more & through
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """The pieces of a block of items and how to verify their hits."""

    def __init__(self, items: list[tuple[int | None, bytes]], error_rate: float, min_piece: int):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        self.items = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            errors = budget(len(text), error_rate, min_piece)
            for offset, piece in pieces(text, errors):
                owners.setdefault(piece.decode("latin-1"), []).append((len(self.items), offset))
            grams = gram_codes(text)
            self.items.append((item_id, text, errors, masks(text), masks(text[::-1]), grams, len(grams) - GRAM * errors))
        for piece, whose in owners.items():
            self.automaton.add_word(piece, (len(piece), whose))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def search(self, text: bytes | None) -> Iterator[tuple]:
        """(item_id, distance, start, stop, budget) of the best match per item, places in the normalised text."""
        data = normalise(text)
        if self.empty or not data:
            return
        found: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, int] = {}
        codes: list[int] = []
        for last, (size, whose) in self.automaton.iter(data.decode("latin-1")):  # bytes as characters
            for number, offset in whose:
                _, item, errors, places, reverse, grams, shared = self.items[number]
                start = last + 1 - size - offset
                best = found.get(number)
                if best and best[0] == 0 or seen.get(number) == start:
                    continue
                seen[number] = start
                if start >= 0 and data.startswith(item, start):
                    found[number] = (0, start, start + len(item))
                    continue
                low = max(0, start - errors)
                stretch = data[low:max(0, start) + len(item) + errors]
                # an edit destroys at most GRAM of the item's grams, so most must stand in the stretch
                if shared > 0:
                    codes = codes or gram_codes(data)
                    if sum(map(set(codes[low:max(low, low + len(stretch) - GRAM + 1)]).__contains__, grams)) < shared:
                        continue
                distance, end = best_match(len(item), places, stretch)
                if distance <= errors and (best is None or distance < best[0]):
                    # the longest start for that end: the same search backwards from it
                    _, back = best_match(len(item), reverse, stretch[:end][::-1])
                    found[number] = (distance, low + end - back, low + end)
        for number, (distance, start, stop) in found.items():
            yield self.items[number][0], distance, start, stop, self.items[number][2]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8().alias("text")).toLocalIterator():
        text = normalise(bytes(row["text"] or b""))
        block.append((row["item_id"], text))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
                   min_piece: int = MIN_PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, item_id, distance, start, stop, budget: each item found in a row of ``docs``, at its best place."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    result = None
    for block in item_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)  # at most block_bytes and one item

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, error_rate, min_piece)

            def pairs():
                for doc_id, text_hash, text in records(batches):
                    for match in matcher.search(text):
                        yield doc_id, text_hash, *match

            yield from batched(pairs(), PAIR_SCHEMA)

        found = rows.mapInArrow(run, PAIR_FIELDS)
        result = found if result is None else result.unionByName(found)
    return result if result is not None else spark.createDataFrame([], PAIR_FIELDS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE,
                    min_piece: int = MIN_PIECE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold an item: one filtering pass per block of items, no shuffle."""
    for block in item_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, sent=sent):
            matcher = Matcher(sent.value, error_rate, min_piece)
            for batch in batches:
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield batch.filter(pa.array([next(matcher.search(t), None) is None for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
