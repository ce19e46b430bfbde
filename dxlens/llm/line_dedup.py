"""Line dedup over a sharded minimal perfect hash of all distinct line keys.

One pass writes a 128-bit hash per (document, distinct line key).  The distinct
hashes, with the number of documents that hold them and the largest doc_id, are
dealt to shards by hash; each shard becomes one compact index row: a minimal
perfect hash, a 32-bit fingerprint and a saturating 8-bit document count per
slot, and the last holder of the repeated slots only.  The documents' hashes
then probe the shard arrays (no join of line texts), and each document drops
the lines that the probes name.

A key found in a third of all documents sends many probes to one shard, so a
shard with more than ``probes_per_task`` probes is copied to as many tasks as
its probes need, and its probes are spread over them by document.

Edge cases: a null or empty text is one empty line; a document is a row, so
repeated rows count as documents of their own and share their fate; a null
doc_id is smaller than every other (and equal to itself); empty tables give no
rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import WHITE, Scratch, batched, keys_joined, records, utf8
from dxlens.llm.mph import MinimalPerfectHash, fingerprint, pack, unpack

KEYS_PER_SHARD = 1 << 16
PROBES_PER_TASK = 1 << 18
SATURATED = 255
_DOC = ["doc_id", "text_hash"]


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE).lower()


def key_length(key: bytes) -> int:
    """Code points of a UTF-8 key."""
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hashed(text: bytes, min_chars: int) -> set[bytes]:
    keys = {line_key(x) for x in text.split(b"\n")}
    return {xxhash.xxh3_128_digest(k) for k in keys if len(k) >= min_chars and key_length(k) >= min_chars}


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, h1, h2): one row per document and distinct key of ``min_chars`` code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashed(t, min_chars) if t else () for t in batch.column(2).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            halves = _halves([d for x in found for d in x])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=[*_DOC, "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, h1 long, h2 long")


def build_index(counted: DataFrame, shards: int, probes_per_task: int) -> DataFrame:
    """(shard, tasks, arrays): one row per shard of the counted keys (h1, h2, n, last)."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        n = table["n"].to_numpy()
        last = table["last"].to_pandas()
        mph = MinimalPerfectHash.build(h1, h2)
        slot = mph.lookup(h1, h2)
        counts, prints = np.zeros(len(n), np.uint8), np.zeros(len(n), np.uint32)
        counts[slot], prints[slot] = np.minimum(n, SATURATED), fingerprint(h1, h2)
        holder, known = np.zeros(len(n), np.int64), np.zeros(len(n), bool)
        holder[slot], known[slot] = last.fillna(0).to_numpy(np.int64), last.notna().to_numpy()
        often = counts > 1
        arrays = pack(**mph.to_arrays(), counts=counts, prints=prints, holder=holder[often], known=known[often])
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int64()),
                         "tasks": pa.array([max(1, -(-int(n.sum()) // probes_per_task))], pa.int64()),
                         "arrays": pa.array([arrays], pa.binary())})

    return (counted.withColumn("shard", F.pmod("h1", F.lit(shards)))
            .groupBy("shard").applyInArrow(build, "shard long, tasks long, arrays binary"))


def probe(hashes: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(doc_id, text_hash, digest) of the keys that a document must drop."""

    def look(index_rows: pa.Table, probes: pa.Table) -> pa.Table:
        if not len(index_rows) or not len(probes):
            return pa.table({"doc_id": pa.array([], pa.int64()), "text_hash": pa.array([], pa.int64()), "digest": pa.array([], pa.binary())})
        arrays = unpack(index_rows["arrays"][0].as_py())
        signed = [probes[c].to_numpy() for c in ("h1", "h2")]
        h1, h2 = (x.view(np.uint64) for x in signed)
        slot = MinimalPerfectHash.from_arrays(arrays).lookup(h1, h2)
        counts = arrays["counts"]
        found = (slot >= 0) & (arrays["prints"][slot] == fingerprint(h1, h2)) & (counts[slot] >= min_docs)
        rank = np.cumsum(counts > 1) - 1
        doc = probes["doc_id"].to_pandas()
        held, known = arrays["holder"], arrays["known"]
        at = rank[slot[found]]
        keeps = np.where(known[at], (doc[found] == held[at]).to_numpy(bool), doc[found].isna().to_numpy())
        lost = np.flatnonzero(found)[~keeps]
        digests = np.stack([x[lost] for x in signed], axis=1).astype("<i8")
        out = probes.select(_DOC).take(pa.array(lost))
        return out.append_column("digest", pa.array([x.tobytes() for x in digests], pa.binary()))

    tasks = index.where("tasks > 1").select("shard", "tasks")
    spread = (hashes.withColumn("shard", F.pmod("h1", F.lit(shards))).join(tasks, "shard", "left")
              .withColumn("part", F.coalesce(F.pmod(F.xxhash64(*_DOC), F.col("tasks")), F.lit(0).cast("long")))
              .drop("tasks"))
    copies = index.select("shard", "arrays", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("part"))
    return (copies.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part"))
            .applyInArrow(look, "doc_id long, text_hash long, digest binary"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
                keys_per_shard: int = KEYS_PER_SHARD, probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """doc_id, kept_text, n_lines, n_dropped per row of ``docs`` (doc_id, text).

    Lines are split at newline; a line's key is the line stripped of ASCII white
    space with A-Z lower-cased.  Keys of at least ``min_chars`` code points held
    by at least ``min_docs`` (2 to 255) documents lose all their lines except in the
    document with the largest doc_id among the holders.
    """
    if not 2 <= min_docs <= SATURATED:
        raise ValueError("min_docs must be between 2 and 255, the range of the index's counts")
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), utf8().alias("text"))
    hashes = scratch.table(line_hashes(docs, min_chars), "hashes")
    counted = scratch.table(hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "counted")
    shards = max(1, -(-counted.count() // keys_per_shard))
    index = scratch.table(build_index(counted, shards, probes_per_task), "index")
    scratch.drop("counted")
    lost = scratch.table(probe(hashes, index, shards, min_docs)
                         .groupBy(*_DOC).agg(F.collect_set("digest").alias("lost")), "lost")
    scratch.drop("hashes", "index")

    def keep(text: bytes | None, lost: list[bytes] | None) -> tuple[bytes, int, int]:
        lines = (text or b"").split(b"\n")
        if not lost:
            return text or b"", len(lines), 0
        gone = set(lost)
        kept = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone]
        return b"\n".join(kept), len(lines), len(lines) - len(kept)

    schema = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches):
        rows = ((doc, *keep(text, gone)) for doc, text, gone in records(batches))
        yield from batched(rows, schema, weigh=1)

    joined = keys_joined(docs, lost, _DOC, "left").select("doc_id", "text", "lost")
    return (joined.mapInArrow(run, "doc_id long, kept binary, n_lines long, n_dropped long")
            .select("doc_id", F.col("kept").cast("string").alias("kept_text"), "n_lines", "n_dropped"))
