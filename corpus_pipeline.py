"""The corpus pipeline: documents through five corpus operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
stored as Parquet and read again as the next stage's documents.  All but the last return the
columns of documents.

1. toxicity: a classifier learned from the labels scores every text; texts at or above the threshold go.
2. simhash_near_dedup: of every group of linked fingerprints the smallest doc_id stays.
3. benchmark_decontamination: documents that hold a benchmark item go.
4. source_mixing: documents as the mix takes them: dropped, in part, whole, or several times.
5. token_files: the rest as id files; one row per document read back from them.

Every stage's operator states what it does with nulls, empty and repeated rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dxlens.llm import common, decontaminate, mixing, simhash, token_files, toxicity
from dxlens.llm.queries import END_ID, tokenizer_path
from dxlens.sources.sinks import table_root

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_HELD: list[common.Scratch] = []


def _stage(fn: Stage) -> Stage:
    """Before a stage, drop the scratch data of the one before: its result has been stored by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _HELD:
            _HELD.pop().release()
        with common.recording() as made:
            out = fn(spark, docs, sf_dir)
        _HELD.extend(made)
        return out

    run.__name__ = fn.__name__
    return run


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    name, = common.free_names(docs.columns, "score")
    scored = toxicity.score(docs, model, docs.columns, name)
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs, shingle_words=4, max_bits=4)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, common.read(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    store = token_files.write_store(docs, tokenizer_path(), END_ID)
    return token_files.read_ids(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]

# SQL cannot express a trained classifier, SimHash components or a tokenizer; tests/llm holds the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's stored result goes once the next one's is stored."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = f"{table_root(spark)}/pipeline-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            common.delete_path(spark, before)
        before = path
    return docs
