"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled (ordered by a hash of their id) into one
stream of words, cut into blocks of ``block_words``.  The schedule has as many
slots as the targets need blocks.  Slot ``t`` has the van der Corput point
``v(t)``, the reversed bits of ``t``; the points are laid over the sources'
cumulative slot counts, so a source owns a stretch of points and its slots lie
evenly over the whole schedule.  A source's slots, ranked by ``t``, take its
blocks in order, epoch after epoch, the last slot only what the target still
needs.  Joining slots with blocks gives the words taken of each document.

All of it is DataFrame work; ranks and offsets are running totals over
range-partitioned tables, so a source with a third of all rows is spread like
any other stretch of the order.  The driver holds a few totals only.

Edge cases: a null text has size 0 and is never taken; a null source is a source
of its own, last in order; rows with equal doc_ids are separate rows; a null doc_id is
shuffled like the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxlens.llm.common import free_names, keys_joined, running_totals, Scratch, WORD_PATTERN

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 2048
SEED = "mix"


def word_count(column: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, number, weight, target for a table of (source, source_size).

    Weights repeat over the sources in code-point order, nulls last.  A target is
    the source's share by weight, at most ``max_repeats`` times its size; what the
    capped sources leave is shared among the others until none is above its cap.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered = running_totals(sources.withColumn("one", F.lit(1).cast("long")), order, "one", scratch, "sources")
    numbered = scratch.table(numbered.select(
        "source", "source_size", F.col("before").alias("number"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before") % len(weights) + 1).cast("int")).alias("weight")),
        "weights")
    cap = F.col("source_size") * max_repeats
    total, level = numbered.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while True:  # the water level only rises: each round caps at least one more source
        over = cap < F.col("weight") * level
        row = numbered.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        new = (total - (row["capped"] or 0)) / row["open"] if row["open"] else level
        if new <= level:
            break
        level = new
    share = F.col("weight") * F.lit(level)
    return numbered.withColumn("target", F.when(cap < share, cap.cast("double")).otherwise(share))


def schedule(sources: DataFrame, scratch: Scratch, block_words: int) -> DataFrame:
    """One row per slot: source number, position ``t``, rank, epoch, block, and the words that the slot takes."""
    needed = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn(
        "slots", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block_words))
    placed = scratch.table(running_totals(needed.where("slots > 0"), ["number"], "slots", scratch, "needed"), "placed")
    total = placed.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    # a source's stretch is cut before it is unrolled, so that no task unrolls a large source alone
    step = 4096
    cut = placed.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / step)))).repartition("number", "piece")
    points = cut.withColumn("at", F.explode(F.sequence(F.col("piece") * step, F.least((F.col("piece") + 1) * step, F.col("slots")) - 1)))
    position = F.conv(F.reverse(F.lpad(F.bin(F.col("before") + F.col("at")), bits, "0")), 2, 10).cast("long")
    slots = points.select("number", F.col("before").alias("first"), "blocks", "slots", "rest", "source_size",
                          position.alias("t"), F.lit(1).cast("long").alias("one"))
    ranked = running_totals(slots, ["number", "t"], "one", scratch, "slots").withColumn("rank", F.col("before") - F.col("first"))
    block = F.col("rank") % F.col("blocks")
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - block * block_words)
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    return ranked.select("number", "t", "rank", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), block.alias("block"),
                         F.when(last, F.col("rest") - block * block_words).otherwise(length).alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, text_hash, size, source, source_size, target, taken, slots, first_slot per row of ``docs`` (doc_id, text, source).

    ``slots`` are the schedule's positions at which the passes over the document begin, by epoch
    (at most ``max_repeats`` of them); sorted by it the mix holds all sources in proportion from the start.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.table(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), word_count().alias("size"), "source",
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle")), "sized")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, max_repeats)
    words = F.floor(F.col("target") + 1e-6)
    positive = F.col("source_size") > 0
    sources = scratch.table(sources.withColumn("full", F.when(positive, F.floor(words / F.col("source_size"))).otherwise(0))
                            .withColumn("rest", words - F.col("full") * F.col("source_size")), "targets")
    starts = running_totals(sources, ["number"], "source_size", scratch, "starts").withColumnRenamed("before", "source_start")

    stream = keys_joined(sized, starts.select("source", "number", "source_size", "target", "source_start"), ["source"], "left")
    stream = running_totals(stream, ["number", "shuffle", "doc_id", "text_hash"], "size", scratch, "stream")
    row = ["doc_id", "text_hash", "size", "source", "source_size", "target"]
    stream = stream.withColumn("offset", F.col("before") - F.col("source_start")).select(*row, "number", "offset")
    end = F.col("offset") + F.col("size")
    held = (stream.where("size > 0")
            .withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block_words), F.floor((end - 1) / block_words))))
            .withColumn("from", F.greatest(F.col("offset") - F.col("block") * block_words, F.lit(0)))
            .withColumn("to", F.least(end - F.col("block") * block_words, F.lit(block_words))))
    slots = schedule(sources, scratch, block_words).select("number", "block", "t", "epoch", "words")
    met = held.join(slots, ["number", "block"], "left")
    takes = F.greatest(F.least(F.col("to"), F.coalesce("words", F.lit(0))) - F.col("from"), F.lit(0))
    # a pass over a document begins in the slot of its epoch that takes the document's first words
    begins = F.when((takes > 0) & (F.col("block") == F.floor(F.col("offset") / block_words)), F.struct("epoch", F.col("t").alias("slot")))
    taken = (met.groupBy(*row, "number", "offset")
             .agg(F.coalesce(F.sum(takes), F.lit(0)).alias("taken"),
                  F.transform(F.array_sort(F.collect_list(begins)), lambda x: x["slot"]).alias("slots")).drop("number", "offset"))
    taken = taken.withColumn("first_slot", F.array_min("slots"))
    return taken.unionByName(stream.where("size = 0").select(*row, F.lit(0).cast("long").alias("taken"),
                                                             F.array().cast("array<long>").alias("slots"), F.lit(None).cast("long").alias("first_slot")))


def mixed_documents(docs: DataFrame, position: str | None = None, **options) -> DataFrame:
    """The documents as the mix takes them: a row per whole pass over a document, and one with its first words for a part.

    The last epoch covers the start of each source's stream, so a partly taken document gives its first words.
    ``position`` names a column for the schedule's position of each row; without it the rows
    are written in the order of the schedule, range-partitioned.  All columns are kept, whatever their names.
    """
    columns = docs.columns
    text_hash, twin, size, taken, slots, number, slot = free_names(columns, "text_hash", "twin", "size", "taken", "slots", "pass", "slot")
    plan = mix(docs, **options).where("taken > 0").select(
        "doc_id", F.col("text_hash").alias(text_hash), F.col("size").alias(size), F.col("taken").alias(taken), F.col("slots").alias(slots))
    # identical rows are told apart by number on both sides
    key = ["doc_id", text_hash]
    plan = plan.withColumn(twin, F.row_number().over(Window.partitionBy(*key).orderBy(taken, slots)))
    rows = docs.withColumn(text_hash, F.xxhash64("text"))
    rows = rows.withColumn(twin, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    met = keys_joined(rows, plan, [*key, twin], "inner")
    passes = F.ceil(F.col(taken) / F.col(size))
    part = F.col(taken) - F.col(number) * F.col(size)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(part >= F.col(size), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    out = met.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), passes - 1))).withColumn("text", text)
    out = out.withColumn(slot, F.get(F.col(slots), F.col(number).cast("int")))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    if position is not None:
        return out.select(*columns, F.col(slot).alias(position))
    return out.repartitionByRange(slot, "doc_id").sortWithinPartitions(slot, "doc_id").select(*columns)
