"""Token-id files with a minimal perfect hash index.

Documents are range-partitioned by doc_id; each task encodes its documents and
writes one shard file: a header, then the raw little-endian ids of its
documents, end id included.  The index maps a document key (doc_id and, for
repeated ids, its occurrence) to a shard file, an offset and a length: keys are
dealt to index shards by hash, each a minimal perfect hash with a 32-bit
fingerprint and the place per slot, so an access reads one index row and
one stretch of ids.

Edge cases: a null or empty text is the end id alone; a null doc_id sorts first;
rows with the same doc_id are ordered by a hash of their text and told apart by their occurrence;
empty tables give an empty store; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from re import compile as pattern

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import RangeReader, Scratch, TaskFile, batched, records
from dxlens.llm.mph import MinimalPerfectHash, fingerprint, pack, unpack

MAGIC = b"DXTOKID1"
HEADER_FORMAT = "<8sII"  # magic, bytes per id, end id
HEADER_BYTES = struct.calcsize(HEADER_FORMAT)
KEYS_PER_SHARD = 1 << 16
CACHED_WORDS = 1 << 19
BATCH_BYTES = 8 << 20

ENTRY_FIELDS = "file string, shard long, doc_id long, occurrence long, offset long, n_tokens long"
PLACE_FIELDS = "doc_id long, occurrence long, file string, shard long, offset long, n_tokens long"


class WordEncoder:
    """A tokenizers file applied to whole texts, remembering each word's ids.

    The file's pre-tokenizer never joins across ASCII white space and its normaliser
    works letter by letter, so a text's ids are its words' ids in order.  Each batch's words are
    told apart once (Arrow's dictionary), so that the memory is asked once per different word of a batch.
    Words of Latin letters, digits and punctuation fall into the pre-tokenizer's pieces here, and the
    file's model encodes each new piece; all other words go through the whole tokenizer, and so do texts with a
    special token's opening ``<|``, unsplit.
    """

    # after lower-casing, the normaliser keeps these as they are, and each match is one pre-token; an
    # apostrophe may open a clipped ending, so words with one are left to the tokenizer
    PIECE = pattern(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
    SIMPLE = pattern(r"[a-zß-öø-ÿ0-9!-&(-/:-@\[-`{-~]+")
    TAILED = r"^(?P<core>(?s:.*)[a-z])(?P<tail>[!-&(-/:-@\[-`{-~]+)$"
    SAMPLE = ("ab", "Straße.", "É9%x", "naïve--co2", "(a)", "x_y@z.org", "12.5", "ÿ!", "#tag", "a/b\\c")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.width, self.letter = (2, "H") if top < 1 << 16 else (4, "I")
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(0xDF, 0x100)}
        # two generations, so that words in use outlive the bound on memory
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        if [self._pieces(w.lower()) for w in self.SAMPLE] != self._whole(list(self.SAMPLE)):
            raise ValueError(f"{path}: its pre-tokenizer or normaliser differs from the one this encoder splits for")

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string array without nulls, as little-endian bytes."""
        special = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist()
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = split.flatten().dictionary_encode()
        ids = self._word_ids(words.dictionary).__getitem__
        codes = words.indices.to_numpy().tolist()
        bounds = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
        out = [b"".join(map(ids, codes[a:z])) for a, z in zip(bounds, bounds[1:])]
        for i in special:
            out[i] = self._whole([texts[i].as_py()])[0]
        return out

    def _word_ids(self, words: pa.StringArray) -> list[bytes]:
        """The ids of different words: those of the word without closing punctuation, then those of the punctuation."""
        parts = pc.extract_regex(words, self.TAILED)
        core, tail = (x.dictionary_encode() for x in (pc.coalesce(pc.struct_field(parts, 0), words), pc.struct_field(parts, 1).fill_null("")))
        cores, tails = (self._ids(x.dictionary.to_numpy(zero_copy_only=False).tolist()) for x in (core, tail))
        pairs = zip(core.indices.to_numpy().tolist(), tail.indices.to_numpy().tolist())
        return [cores[c] + tails[t] for c, t in pairs]

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.older = {"": b""}, self.cache
        found, others = list(map(self.cache.get, words)), []
        for i, word in enumerate(words):
            if found[i] is not None:
                continue
            if word.isascii() and word.isalpha():
                found[i] = self._piece(word)
                continue
            low = word.lower()
            if self.SIMPLE.fullmatch(low):
                found[i] = self._pieces(low)
            else:
                others.append(i)
        for i, ids in zip(others, self._whole([words[i] for i in others])):
            found[i] = self.cache[words[i]] = ids
        return found

    def _pieces(self, word: str) -> bytes:
        return b"".join([self.cache.get(p) or self._piece(p) for p in self.PIECE.findall(word)])

    def _piece(self, piece: str) -> bytes:
        """The ids of a pre-token that is not in the younger generation."""
        ids = self.older.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece if piece.isascii() else piece.translate(self.letters))
            ids = self.packed(*[t.id for t in tokens])
        self.cache[piece] = ids
        return ids

    def packed(self, *ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(*e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The task process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


@dataclass
class TokenStore:
    """A written store: ``index`` (shard, arrays), ``keys`` (doc_id, occurrence), ``starts`` (ids before each shard file)."""

    index: DataFrame
    keys: DataFrame
    starts: dict[int, int]
    shards: int
    id_bytes: int


def _write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    schema = pa.schema([("file", pa.string()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("occurrence", pa.int64()),
                        ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
        texts = pc.fill_null(batch.column(1), "")
        held = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(texts)]
        for a, z in zip(cuts, cuts[1:]):
            yield batch.column(0).slice(a, z - a).to_pylist(), texts.slice(a, z - a)

    def run(batches):
        enc, file = encoder(tokenizer), None
        end = enc.packed(end_id)

        def entries():
            nonlocal file
            last, seen, at = object(), 0, 0
            shard = TaskContext.get().partitionId()
            for ids, texts in (g for batch in batches if len(batch) for g in groups(batch)):
                if file is None:
                    file = TaskFile(folder, f"shard-{shard:06d}", ".ids")
                    file.write(struct.pack(HEADER_FORMAT, MAGIC, enc.width, end_id))
                for doc_id, tokens in zip(ids, enc.encode(texts)):
                    file.write(tokens + end)
                    seen = seen + 1 if doc_id == last else 0
                    last, n = doc_id, len(tokens) // enc.width + 1
                    yield file.uri, shard, doc_id, seen, at, n
                    at += n
            if file is not None:
                file.close()

        yield from batched(entries(), schema)

    return docs.mapInArrow(run, ENTRY_FIELDS)


def _key_hashes(doc_ids: pd.Series, occurrences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the keys (doc_id or none, occurrence)."""
    packed = (struct.pack("<?qq", d is not None, d or 0, o) for d, o in zip(doc_ids, occurrences))
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, packed)), "<u8").reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("index_shard", F.pmod(F.xxhash64("doc_id", "occurrence"), F.lit(shards)))


def _continued(entries: DataFrame) -> DataFrame:
    """Occurrences counted on from the shards before, for a doc_id that runs over several shards.

    The driver sees one row per shard: its first and last doc_id and how often they occur.
    """
    ends = (entries.groupBy("shard").agg(F.min_by("doc_id", "offset").alias("first"), F.max_by("doc_id", "offset").alias("last"),
                                         F.max_by("occurrence", "offset").alias("last_occurrence"))
            .orderBy("shard").collect())
    carry, previous, count = [], object(), 0
    for row in ends:
        start = count if row["first"] == previous else 0
        if start:
            carry.append((row["shard"], row["first"], start))
        count = row["last_occurrence"] + 1 + (start if row["last"] == row["first"] else 0)
        previous = row["last"]
    if not carry:
        return entries
    more = entries.sparkSession.createDataFrame(carry, "_shard long, _first long, _carry long")
    held = entries.join(F.broadcast(more), (F.col("shard") == F.col("_shard")) & F.col("doc_id").eqNullSafe(F.col("_first")), "left")
    return held.withColumn("occurrence", F.col("occurrence") + F.coalesce("_carry", F.lit(0))).drop("_shard", "_first", "_carry")


def write_store(docs: DataFrame, tokenizer: str, end_id: int, scratch: Scratch | None = None,
                keys_per_shard: int = KEYS_PER_SHARD) -> TokenStore:
    """Encode every text of ``docs`` (doc_id, text), write the shard files in ascending doc_id order and index them."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
               .repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text"))
    entries = scratch.table(_write_shards(ordered, scratch.path("shards"), tokenizer, end_id), "entries")
    starts, so_far = {}, 0
    for shard, total in sorted(entries.groupBy("shard").agg(F.sum("n_tokens")).collect()):
        starts[shard] = so_far
        so_far += total
    entries = _continued(entries)
    shards = max(1, -(-entries.count() // keys_per_shard))

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = _key_hashes(table["doc_id"].to_pylist(), table["occurrence"].to_numpy())
        mph = MinimalPerfectHash.build(h1, h2)
        order = np.argsort(mph.lookup(h1, h2))
        files, file = np.unique(table["file"].to_pandas().to_numpy(str), return_inverse=True)
        column = {c: table[c].to_numpy()[order] for c in ("shard", "offset", "n_tokens")}
        arrays = pack(**mph.to_arrays(), prints=fingerprint(h1, h2)[order], files=files, file_of=file[order].astype(np.int32), **column)
        return pa.table({"index_shard": table["index_shard"].slice(0, 1), "arrays": pa.array([arrays], pa.binary())})

    index = scratch.table(_with_shard(entries, shards).groupBy("index_shard")
                          .applyInArrow(build, "index_shard long, arrays binary"), "index")
    return TokenStore(index, entries.select("doc_id", "occurrence"), starts, shards, encoder(tokenizer).width)


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """The place of each key (doc_id, occurrence) that the store holds, found through the index."""

    def look(index_rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out = {c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("occurrence", pa.int64()), ("file", pa.string()),
                                               ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64()))}
        if not len(index_rows) or not len(wanted):
            return pa.table(out)
        arrays = unpack(index_rows["arrays"][0].as_py())
        h1, h2 = _key_hashes(wanted["doc_id"].to_pylist(), wanted["occurrence"].to_numpy())
        slot = MinimalPerfectHash.from_arrays(arrays).lookup(h1, h2)
        held = np.flatnonzero((slot >= 0) & (arrays["prints"][slot] == fingerprint(h1, h2)))
        slot = slot[held]
        return (wanted.select(["doc_id", "occurrence"]).take(pa.array(held))
                .append_column("file", pa.array(arrays["files"][arrays["file_of"][slot]], pa.string()))
                .append_column("shard", pa.array(arrays["shard"][slot]))
                .append_column("offset", pa.array(arrays["offset"][slot]))
                .append_column("n_tokens", pa.array(arrays["n_tokens"][slot])))

    wanted = _with_shard(keys.select("doc_id", "occurrence"), store.shards)
    return (store.index.groupBy("index_shard").cogroup(wanted.groupBy("index_shard")).applyInArrow(look, PLACE_FIELDS))


def read_ids(store: TokenStore, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of the given keys, or of all, read from the files."""
    width = store.id_bytes
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    starts = store.starts

    def run(batches):
        reader = RangeReader()

        def rows():
            for doc_id, _, file, shard, offset, n in records(batches):
                raw = reader.read(file, HEADER_BYTES + offset * width, n * width)
                yield doc_id, starts[shard] + offset, n, np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
            reader.close()

        yield from batched(rows(), schema, weigh=3)

    places = locate(store, store.keys if keys is None else keys)
    ordered = places.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")
    return ordered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
