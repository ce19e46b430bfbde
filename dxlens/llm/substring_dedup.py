"""Substring dedup by a compressed FM-index per shard.

A document is cut into pieces: runs of windows (``window`` consecutive words)
with the same minimizer, the least hash of the window's short word runs.  Equal windows have equal
minimizers, so all places of a window lie in one shard when pieces are dealt by minimizer.  A
minimizer that occurs once has no repeated window; a bit filter of fixed size holds those that occur
more often, and only their pieces are sent, as words.

A shard joins its different pieces, in document order, to one text, indexes it (wavelet tree over the
Burrows-Wheeler transform) and streams the pieces through backward search: the matching statistics, capped
at the window length, say for every window where it first occurs, and windows that occur earlier are
reported as intervals of their document.  The documents then drop the covered words.

A minimizer with more than ``hot_pieces`` pieces would fill a shard alone: its windows are dealt singly by a
128-bit hash instead, and the earliest of each is found by a pre-aggregated minimum.

Edge cases: a null text has no words; texts shorter than a window keep all; rows with the same doc_id and
text are one document and keep or lose the same words; rows that share a doc_id only are ordered by a hash of their text; a
null doc_id comes before all others; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import Scratch, batched, keys_joined, records, utf8
from dxlens.llm.fm_index import FMIndex
from dxlens.llm.mph import mix

WINDOW = 20
RUN = 4
FILTER_BITS = 1 << 28
FILTER_BLOCK = 1 << 20
PIECES_PER_SHARD = 80_000
HOT_PIECES = 50_000

_DOC = ["doc_id", "text_hash"]
PIECE_FIELDS = "doc_id long, text_hash long, start long, minimizer long, words binary"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()),
                          ("minimizer", pa.int64()), ("words", pa.binary())])
SPAN_FIELDS = "doc_id long, text_hash long, start long, stop long"
SPAN_SCHEMA = pa.schema([(x.split(" ")[0], pa.int64()) for x in SPAN_FIELDS.split(", ")])


def cut(words: list[bytes], window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizers, first windows, numbers of windows, places) of a text's pieces.

    ``places`` is 2 where the text has the minimizer's word run more than once, so that even
    one piece may hold equal windows, else 1.
    """
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    runs = np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        runs = mix(runs, hashes[k:k + len(runs)], k)
    # sliding minimum by doubling: spans 1, 2, 4, ... and two overlapping ones for the rest
    span, size, least = window - run + 1, 1, runs
    while size * 2 <= span:
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:n], least[span - size:span - size + n])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ordered = np.sort(runs)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    places = 1 + np.isin(least[first], twice) if len(twice) else np.ones(len(first), np.int64)
    return least[first], first, np.diff([*first, n]), places


def minimizers(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(minimizer, n): places per minimizer, summed per batch of documents first."""

    def count(batches):
        for batch in batches:
            found = [cut(t.split(), window, run) for t in batch.column(0).to_pylist() if t]
            values = np.concatenate([np.zeros(0, np.uint64), *(f[0] for f in found)])
            places = np.concatenate([np.zeros(0, np.int64), *(f[3] for f in found)])
            values, which = np.unique(values, return_inverse=True)
            n = np.bincount(which, weights=places, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], names=["minimizer", "n"])

    return docs.select("text").mapInArrow(count, "minimizer long, n long").groupBy("minimizer").agg(F.sum("n").alias("n"))


def repeated_filter(counts: DataFrame) -> bytes:
    """Bits of the minimizers that occur more than once: FILTER_BITS in all, whatever the corpus."""

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(FILTER_BLOCK, bool)
        bits[table["at"].to_numpy() % FILTER_BLOCK] = True
        return pa.table({"block": table["block"].slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    at = F.pmod("minimizer", F.lit(FILTER_BITS))
    blocks = (counts.where("n > 1").select(at.alias("at")).distinct().withColumn("block", F.floor(F.col("at") / FILTER_BLOCK))
              .groupBy("block").applyInArrow(block, "block long, bits binary"))
    size = FILTER_BLOCK // 8
    out = bytearray(FILTER_BITS // 8)
    for row in blocks.toLocalIterator():
        out[row["block"] * size:(row["block"] + 1) * size] = row["bits"]
    return bytes(out)


def repeated_pieces(docs: DataFrame, counts: DataFrame, hot: list[int], window: int, run: int) -> DataFrame:
    """The pieces whose minimizer passes the filter; those of hot minimizers window by window, minimizer null."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(repeated_filter(counts))
    hot_set = frozenset(hot)

    def emit(batches):
        bits = np.frombuffer(sent.value, np.uint8)

        def pieces():
            for doc_id, text_hash, text in records(batches):
                words = (text or b"").split()
                values, first, number, _ = cut(words, window, run)
                if not len(values):
                    continue
                at = (values.view(np.int64) % FILTER_BITS).astype(np.int64)
                passed = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                for m, a, n in zip(values.view(np.int64)[passed].tolist(), first[passed].tolist(), number[passed].tolist()):
                    if m in hot_set:
                        for i in range(a, a + n):
                            yield doc_id, text_hash, i, None, xxhash.xxh3_128_digest(b" ".join(words[i:i + window]))
                    else:
                        yield doc_id, text_hash, a, m, b" ".join(words[a:a + n + window - 1])

        yield from batched(pieces(), PIECE_SCHEMA, weigh=4)

    return docs.select(*_DOC, "text").mapInArrow(emit, PIECE_FIELDS)


def _order(table: pa.Table) -> np.ndarray:
    """Row numbers in document order: doc_id, null first, then text hash, then start."""
    doc = table["doc_id"].to_pandas()
    known = doc.notna().to_numpy()
    return np.lexsort((table["start"].to_numpy(), table["text_hash"].to_numpy(), doc.fillna(0).to_numpy(np.int64), known))


def shard_spans(table: pa.Table, window: int) -> pa.Table:
    """The intervals of words, per document, whose windows occur earlier in the shard."""
    table = table.take(pa.array(_order(table)))
    words = table["words"].to_pylist()
    start = table["start"].to_numpy()
    doc = list(zip(table["doc_id"].to_pylist(), table["text_hash"].to_pylist()))
    seen: dict[bytes, int] = {}
    rows, low, high = [], [], []  # spans: row of the table, first and past-last word
    different, sizes = [], []
    numbers: dict[bytes, int] = {}
    text: list[np.ndarray] = []
    for i, piece in enumerate(words):
        first = seen.setdefault(piece, i)
        if first == i:
            split = piece.split()
            text.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in split), np.int64, len(split)))
            different.append(i)
            sizes.append(len(split))
        elif doc[first] != doc[i] or start[first] != start[i]:  # a copy of an earlier piece, wholly repeated
            rows.append(i)
            low.append(start[i])
            high.append(start[i] + piece.count(b" ") + 1)
    # copies that begin at the same place of equal rows share the first one's fate
    twins: dict[int, list[int]] = {}
    for i, piece in enumerate(words):
        first = seen[piece]
        if first != i and doc[first] == doc[i] and start[first] == start[i]:
            twins.setdefault(first, []).append(i)
    if different:
        sizes = np.array(sizes)
        joined = np.concatenate([x for t in text for x in (t, np.zeros(1, np.int64))])
        begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        first = FMIndex(joined, window).first_occurrences(joined, begins, sizes)
        repeated = np.flatnonzero((first >= 0) & (first < np.arange(len(first))))
        if len(repeated):
            piece = np.searchsorted(begins, repeated, side="right") - 1
            opens = np.concatenate([[True], (np.diff(repeated) > 1) | (np.diff(piece) > 0)])
            heads = np.flatnonzero(opens)
            tails = np.concatenate([heads[1:], [len(repeated)]]) - 1
            for a, z in zip(heads.tolist(), tails.tolist()):
                owner = different[piece[a]]
                at = start[owner] + repeated[a] - begins[piece[a]]
                for row in (owner, *twins.get(owner, ())):
                    rows.append(row)
                    low.append(at)
                    high.append(at + repeated[z] - repeated[a] + window)
    return (table.select(_DOC).take(pa.array(rows, pa.int64()))
            .append_column("start", pa.array(np.array(low, np.int64)))
            .append_column("stop", pa.array(np.array(high, np.int64))))


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int, run: int, pieces_per_shard: int, hot_pieces: int) -> DataFrame:
    """doc_id, text_hash, start, stop: words covered by windows that occur earlier."""
    counts = scratch.table(minimizers(docs, window, run), "minimizers")
    total = counts.where("n > 1").agg(F.sum("n")).first()[0] or 0
    limit = max(hot_pieces, total // 100_000)  # so at most 100,000 of them
    hot = [row["minimizer"] for row in counts.where(F.col("n") > limit).select("minimizer").collect()]
    shards = max(1, -(-total // pieces_per_shard))
    pieces = repeated_pieces(docs, counts, hot, window, run)
    if hot:
        pieces = scratch.table(pieces, "pieces")
    spans = (pieces.where("minimizer IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("minimizer"), F.lit(shards)))
             .groupBy("shard").applyInArrow(lambda t: shard_spans(t, window), SPAN_FIELDS))
    if hot:
        place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash", "start")
        single = pieces.where("minimizer IS NULL").select(*_DOC, "start", "words")
        first = single.groupBy("words").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        later = single.join(first.select("words", "first"), "words").where(place != F.col("first"))
        spans = spans.unionByName(later.select(*_DOC, "start", (F.col("start") + window).alias("stop")))
    return spans


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching intervals as one."""
    out: list[list[int]] = []
    for a, z in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup_substrings(docs: DataFrame, window: int = WINDOW, run: int = RUN, pieces_per_shard: int = PIECES_PER_SHARD,
                     hot_pieces: int = HOT_PIECES) -> DataFrame:
    """doc_id, kept_text (words joined by one space), n_words, n_removed, spans per row of ``docs`` (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    spans = scratch.table(repeated_spans(docs, scratch, window, run, pieces_per_shard, hot_pieces), "spans")
    scratch.drop("pieces", "minimizers")
    held = spans.groupBy(*_DOC).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def keep(batches) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text, found in records(batches):
                words, kept, at = (text or b"").split(), [], 0
                covered = merge(found or [])
                for a, z in covered:
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                yield doc_id, b" ".join(kept), len(words), len(words) - len(kept), [{"start": a, "stop": z} for a, z in covered]
        yield from batched(rows(), schema, weigh=1)

    joined = keys_joined(docs, held, _DOC, "left").select("doc_id", "text", "spans")
    return (joined.mapInArrow(keep, "doc_id long, kept binary, n_words long, n_removed long, spans array<struct<start:long,stop:long>>")
            .select("doc_id", F.col("kept").cast("string").alias("kept_text"), "n_words", "n_removed", "spans"))
