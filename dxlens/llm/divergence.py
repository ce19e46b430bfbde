"""Vocabulary divergence between the sources of each language, by chunk factorization.

A text falls into chunks at ASCII white space, which no term contains, so the
terms of a text are the terms of its chunks.  One pass counts the chunks of
every document and adds them up inside the task; only the sums travel.  Each
globally distinct chunk is then split into terms once, and its terms are joined
back to the sums.

A document may hold a term in several chunks ("end", "End."), so the documents
of a term are not the sum over its chunks.  The sums still decide most terms: the
largest count of one chunk is a lower bound, the sum over chunks an upper
one.  A chunk in fewer than ``min_docs`` documents carries the numbers of all of them, so
for terms between the bounds, all of whose chunks are that rare, the distinct
documents are counted from these short lists.  Nothing is estimated.

The divergence of two sources is a sum over all kept terms, also those that
neither has.  The terms of a language are dealt to blocks by hash; a task holds one
block as a (sources x terms) array of at most about ``cells`` cells and returns
one sum for each pair of sources, so no row per pair and term exists.

Edge cases: null text, lang and source are empty strings; a document is a row, so
repeated rows and ids count each; documents without terms still make their
group; a language without kept terms has divergence 0 between its sources;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxlens.llm.common import Scratch

TERM_PATTERN = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = 1_000_000_000
HELD_BYTES = 32 << 20
CELLS = 1 << 20


def chunk_sums(docs: DataFrame, min_docs: int, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, chunk, docs, rows, sources, n): chunks counted per document and added up over some ``held_bytes`` of text.

    ``rows`` numbers the documents, and is empty where ``docs`` reaches ``min_docs``; ``n`` are the
    chunk's occurrences in each of ``sources``, which are hashes of the names.
    """

    def added(table: pa.Table) -> pa.RecordBatch:
        words = pc.ascii_split_whitespace(_flat(table["text"]))
        chunks = words.flatten().dictionary_encode()
        code, width = chunks.indices.to_numpy().astype(np.int64), max(1, len(chunks.dictionary))
        langs, sources = (_flat(table[c]).dictionary_encode() for c in ("lang", "source"))
        doc = np.repeat(np.arange(len(table)), np.diff(words.offsets.to_numpy()))
        blank = chunks.dictionary.index("").as_py()
        if blank >= 0:
            doc, code = doc[code != blank], code[code != blank]
        # every document's different chunks with their counts, then ordered by language, chunk and source
        key, n = np.unique(doc * width + code, return_counts=True)
        doc, code = np.divmod(key, width)
        chunk = langs.indices.to_numpy().astype(np.int64)[doc] * width + code
        source = sources.indices.to_numpy()[doc]
        order = np.lexsort((source, chunk))
        chunk, source, n, doc = chunk[order], source[order], n[order], doc[order]
        new = np.diff(chunk, prepend=-1) != 0
        start, part = np.flatnonzero(new), np.flatnonzero(new | (np.diff(source, prepend=-1) != 0))
        held = np.diff(np.append(start, len(chunk)))
        few = held < min_docs
        lang, code = np.divmod(chunk[start], width)
        parts = np.append(np.searchsorted(part, start), len(part))
        return pa.RecordBatch.from_arrays([
            langs.dictionary.take(pa.array(lang)), chunks.dictionary.take(pa.array(code)), pa.array(held),
            _lists(np.append(0, np.cumsum(np.where(few, held, 0))), table["number"].to_numpy()[doc[np.repeat(few, held)]]),
            _lists(parts, sources.dictionary.to_numpy()[source[part]]),
            _lists(parts, np.add.reduceat(n, part) if len(part) else n, pa.int32())], names=["lang", "chunk", "docs", "rows", "sources", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= held_bytes:
                yield added(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            yield added(pa.Table.from_batches(held))

    numbered = docs.select(F.monotonically_increasing_id().alias("number"), _named("lang"), _key().alias("source"), _named("text"))
    return numbered.mapInArrow(run, "lang string, chunk string, docs long, rows array<long>, sources array<long>, n array<int>")


def _key():
    return F.xxhash64(_named("source"))


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _named(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def probability(n: str, total: str, terms: str):
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exact for any 64-bit counts."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) div CAST({total} + 2 * {terms} AS DECIMAL(20,0))")


def divergence(p: str, q: str):
    """floor((p - q)^2 / (p + q)); both are at most UNIT + 1, so 64 bits hold the square."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def pair_sums(counts: DataFrame, groups: DataFrame, cells: int = CELLS) -> DataFrame:
    """(lang, source, item, value): the divergence summed over all kept terms, for every ordered pair of a language's sources.

    ``counts``: (lang, source, term, p) where the count is not 0; ``groups``: (lang, source, v,
    p0), the number of kept terms and the p of a count of 0.  Every (lang, block, tile) is one
    task's group: all sources by the block's terms, summed for the tile's sources.
    """
    sized = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("v"))
    deal = sized.select("lang", F.expr(f"greatest(1L, ceil(v * s / {cells}))").alias("blocks"),
                        F.expr(f"greatest(1L, ceil(s * s / {cells}))").alias("tiles"))
    every = "sequence(0L, tiles - 1)"
    left = (counts.join(deal, "lang")
            .select("lang", F.expr("pmod(xxhash64(term), blocks)").alias("block"), F.explode(F.expr(every)).alias("tile"), "term", "source", "p"))
    right = (groups.join(deal, "lang").withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
             .select("lang", "block", F.explode(F.expr(every)).alias("tile"), "tiles", "source", "p0"))

    def sums(filled: pa.Table, sources: pa.Table) -> pa.Table:
        names = sorted(sources["source"].to_pylist(), key=str.encode)
        place = {x: i for i, x in enumerate(names)}
        p0 = np.zeros(len(names), np.int64)
        p0[[place[x] for x in sources["source"].to_pylist()]] = sources["p0"].to_numpy()
        column, terms = (filled["term"].dictionary_encode().combine_chunks(), 0) if len(filled) else (None, 0)
        if column is not None:
            column = column if isinstance(column, pa.DictionaryArray) else column.chunk(0)
            terms = len(column.dictionary)
        p = np.repeat(p0[:, None], terms, axis=1)
        if terms:
            p[[place[x] for x in filled["source"].to_pylist()], column.indices.to_numpy()] = filled["p"].to_numpy()
        tile, tiles = sources["tile"][0].as_py(), sources["tiles"][0].as_py()
        mine = range(tile, len(names), tiles)
        values = [((p - p[a]) ** 2 // (p + p[a])).sum(axis=1) for a in mine]
        others = [np.delete(np.arange(len(names)), a) for a in mine]
        sources_, items = (pa.array(x, pa.string()) for x in (
            [names[a] for a in mine for _ in range(len(names) - 1)], [names[b] for o in others for b in o.tolist()]))
        value = np.concatenate([np.zeros(0, np.int64), *(v[o] for v, o in zip(values, others))])
        return pa.table({"lang": pa.array([sources["lang"][0].as_py()] * len(value), pa.string()),
                         "source": sources_, "item": items, "value": pa.array(value, pa.int64())})

    keys = ["lang", "block", "tile"]
    return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInArrow(sums, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))


def _ranked(rows: DataFrame):
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def kept_counts(docs: DataFrame, min_docs: int, scratch: Scratch, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(lang, key, term, n) of the terms that at least ``min_docs`` documents of the language hold, exactly; ``key`` hashes the source."""
    sums = scratch.table(chunk_sums(docs, min_docs, held_bytes), "sums")
    terms = F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM_PATTERN), 0)
    chunks = scratch.table(
        sums.select("chunk", "lang", "docs").repartition("chunk")
        .groupBy("chunk", "lang").agg(F.sum("docs").alias("docs"))
        .groupBy("chunk").agg(F.collect_list(F.struct("lang", "docs")).alias("langs"))
        .select("chunk", "langs", terms.alias("terms")).where(F.size("terms") > 0), "chunks")
    spread = scratch.table(
        chunks.select(F.explode(F.array_distinct("terms")).alias("term"), "langs").select("term", F.inline("langs"))
        .groupBy("lang", "term").agg(F.max("docs").alias("top"), F.sum("docs").alias("all"))
        .where(F.col("all") >= min_docs)
        .select("lang", "term", (F.col("top") < min_docs).alias("open")), "spread")
    # within a chunk a term may stand several times: all count as occurrences, the documents once
    wanted = (chunks.select("chunk", F.explode("terms").alias("term"), F.col("langs.lang").alias("langs"))
              .select("chunk", "term", F.explode("langs").alias("lang")).join(spread, ["lang", "term"]))
    hits = scratch.table(sums.join(wanted, ["lang", "chunk"])
                         .select("lang", "term", F.when(F.col("open"), F.col("rows")).alias("rows"), "sources", "n"), "hits")
    scratch.drop("sums", "chunks")
    rare = (hits.select("lang", "term", F.explode("rows").alias("row")).distinct()
            .groupBy("lang", "term").count().where(F.col("count") >= min_docs).select("lang", "term"))
    kept = spread.where(~F.col("open")).select("lang", "term").unionByName(rare)
    counts = (hits.select("lang", "term", F.explode(F.arrays_zip("sources", "n")).alias("x"))
              .groupBy("lang", F.col("x.sources").alias("key"), "term").agg(F.sum("x.n").alias("n")))
    counts = scratch.table(counts.join(kept, ["lang", "term"]).select("lang", "key", "term", "n"), "counts")
    scratch.drop("hits", "spread")
    return counts


def source_divergence(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, cells: int = CELLS,
                      held_bytes: int = HELD_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source).

    Part ``pair``: the divergence from every other source of the language, all ranks.  Part ``term``:
    the ``top_terms`` kept terms that set the source most apart from its language as a whole.
    Two sources of one name hash would be counted as one: that fails, and no result is given.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    named = scratch.table(docs.select(_named("lang"), _named("source"), _key().alias("key")).distinct(), "named")
    if not named.groupBy("lang", "key").count().where("count > 1").isEmpty():
        raise ValueError("two sources of a language have the same 64-bit hash")
    counts = kept_counts(docs, min_docs, scratch, held_bytes).join(named, ["lang", "key"]).drop("key")

    langs = counts.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (named.select("lang", "source")
              .join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"]))
    groups = scratch.table(groups.withColumn("p0", F.when(F.col("v") > 0, probability("0L", "total", "v")).otherwise(0)), "groups")
    priced = (counts.join(groups, ["lang", "source"])
              .withColumn("p", probability("n", "total", "v")).select("lang", "source", "term", "n", "p", "v", "lang_total"))
    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    apart = (priced.join(overall, ["lang", "term"]).withColumn("q", probability("lang_n", "lang_total", "v"))
             .where((F.col("n") > 0) & (F.col("p") > F.col("q")))
             .select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value")))
    pairs = _ranked(pair_sums(priced.select("lang", "source", "term", "p"), groups.select("lang", "source", "v", "p0"), cells))
    tops = _ranked(apart).where(F.col("rank") <= top_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(*columns)
            .unionByName(tops.withColumn("part", F.lit("term")).select(*columns)))
