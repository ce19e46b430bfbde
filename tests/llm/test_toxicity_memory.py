"""Scoring: what crosses to the task, and words worked off in chunks."""

import numpy as np
from pyspark.sql import functions as F

from dxlens.llm import toxicity
from dxlens.llm.subwords import BUCKETS


def _model():
    return toxicity.Model(np.random.default_rng(3).normal(0, 1, BUCKETS).astype(np.float32), -1.0)


def test_a_kept_text_crosses_once(spark):
    docs = spark.createDataFrame([(1, "Ab cdä ef", "x"), (2, None, "y"), (3, "", None), (4, "ab ab  zz\n", "x")],
                                 "doc_id long, text string, source string")
    model = _model()
    kept = toxicity.score(docs, model, docs.columns)
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "cast(text" not in plan and kept.columns == ["doc_id", "text", "source", "score"]
    alone = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    rows = {r.doc_id: r for r in kept.collect()}
    assert {d: r.score for d, r in rows.items()} == alone
    assert [rows[d].text for d in (1, 2, 3, 4)] == ["Ab cdä ef", None, "", "ab ab  zz\n"]
    as_bytes = docs.withColumn("text", F.col("text").cast("binary"))
    assert {r.doc_id: r.score for r in toxicity.score(as_bytes, model, as_bytes.columns).collect()} == alone


def test_words_in_chunks_give_the_same_numbers():
    words = [f"w{i * 7919}x{i % 13}".encode() for i in range(1000)] + [b"a", b"!!!"]
    model = _model()
    assert np.array_equal(model.words(words, chunk=64), model.words(words, chunk=1 << 20))
    assert len(model.words([])) == 0
