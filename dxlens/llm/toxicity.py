"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its byte n-grams (with word
marks) and of the whole word, each hashed to a bucket; a text's vector is the mean over its
different words and ``PAD`` words of vector zero, which keep chance words of a very
short text from deciding; a softmax over it gives the score.  Embeddings and
softmax are trained together by full-batch Adam on a bounded sample of labelled
rows.  As everything after the embeddings is linear, scoring needs one
number per bucket: a misspelt word scores by the n-grams it shares with known ones.

The sample is the ``max_rows`` labelled rows of each class that come first by a hash
of their doc_id, texts over 1/32 of the class's half of ``max_bytes`` after all others; of these, in order, each
that still fits into that half is learned, and the first one always. It is all the driver ever holds, and sizes
decide before texts are fetched.
Every text is scored whole, by tasks that remember each word's number.

Edge cases: a text without words scores as the class balance alone; rows
without a label, with a null label or with a null doc_id are scored, never learned from; a document
with several labels is learned once per label; no usable labels give score 0 for all; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dxlens.llm.common import free_names, Scratch, utf8
from dxlens.llm.subwords import BUCKETS, Bags, fitting, held_out, sample_order, sized, subwords, texts_of, tokens

DIMENSIONS = 4
MIN_TEXTS = 8
PAD = 40
FLOOR = 0.03
DECAY = 0.005
MAX_ROWS = 3000
MAX_BYTES = 8 << 20
STEPS = 100
RATE = 0.25
THRESHOLD = 0.3
CACHED_WORDS = 1 << 19


@dataclass
class Model:
    """``weight``: per bucket, the log-odds that it adds to a word's mean; ``bias``: the log-odds of a text without words."""

    weight: np.ndarray
    bias: float

    def words(self, words: list[bytes], chunk: int = 1 << 12) -> np.ndarray:
        """Each word's number; words are worked off in chunks, so that only the numbers outlive a chunk."""
        parts = [self._words(words[i:i + chunk]) for i in range(0, len(words), chunk)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _words(self, words: list[bytes]) -> np.ndarray:
        buckets, starts = subwords(words)
        sizes = np.diff([*starts, len(buckets)])
        return np.add.reduceat(self.weight[buckets].astype(np.float64), starts) / sizes


def train(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, rate: float = RATE,
          dimensions: int = DIMENSIONS, prior: float | None = None, seed: int = 7) -> Model:
    """Embeddings and softmax, jointly, by full-batch Adam on mean cross-entropy.

    ``prior`` is the share of label 1 among all labels, where the sample's differs.
    """
    labels = np.asarray(labels, np.int64)
    if not len(labels):
        return Model(np.zeros(BUCKETS, np.float32), -np.inf)
    vocabulary: dict[bytes, int] = {}
    word, doc, count = [], [], []
    for i, text in enumerate(texts):
        bag = {vocabulary.setdefault(w, len(vocabulary)) for w in tokens(text)}
        word.append(np.fromiter(bag, np.int64, len(bag)))
        count.append(np.full(len(bag), 1 / (len(bag) + PAD), np.float32))
        doc.append(np.full(len(bag), i))
    word, doc, count = np.concatenate(word), np.concatenate(doc), np.concatenate(count)
    buckets, starts = subwords(list(vocabulary)) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = np.diff([*starts, len(buckets)])
    owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), sizes)
    # a bucket met in few texts can only be learned by heart
    met = np.bincount(buckets, weights=np.bincount(word, minlength=len(vocabulary))[owner], minlength=BUCKETS)
    kept = met[buckets] >= MIN_TEXTS
    buckets, owner = buckets[kept], owner[kept]
    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    column = np.zeros(BUCKETS, np.int32)
    column[used] = np.arange(len(used))
    grams = Bags(owner, column[buckets], (1 / sizes)[owner].astype(np.float32), len(vocabulary), len(used))
    del buckets, owner, kept
    bags = Bags(doc, word, count, len(texts), len(vocabulary))

    rng = np.random.default_rng(seed)
    sampled = labels.mean()
    parameters = {"e": rng.normal(0, 0.05, (len(used), dimensions)).astype(np.float32),
                  "w": rng.normal(0, 1.0, (dimensions, 2)).astype(np.float32),
                  "b": np.log(np.clip([1 - sampled, sampled], 1e-3, None)).astype(np.float32)}
    moment = {k: np.zeros_like(v) for k, v in parameters.items()}
    square = {k: np.zeros_like(v) for k, v in parameters.items()}
    floor: dict[str, float] = {}
    target = np.eye(2, dtype=np.float32)[labels]
    for step in range(1, steps + 1):
        e, w, b = (parameters[k] for k in "ewb")
        hidden = bags.forward(grams.forward(e))
        logits = hidden @ w + b
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = ((p - target) / len(texts)).astype(np.float32)
        gradient = {"w": hidden.T @ error, "b": error.sum(axis=0), "e": grams.backward(bags.backward(error @ w.T))}
        for k, g in gradient.items():
            # the floor keeps buckets of faint gradients, most of them chance, from steps as long as the telling ones'
            floor.setdefault(k, FLOOR * float(np.abs(g).max(initial=0)) + 1e-12)
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            scale = rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            kept = 1 - rate * DECAY if k == "e" else 1
            parameters[k] = (kept * parameters[k] - scale * moment[k] / (np.sqrt(square[k]) + floor[k])).astype(np.float32)
    axis = parameters["w"][:, 1] - parameters["w"][:, 0]
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = parameters["e"] @ axis
    bias = float(parameters["b"][1] - parameters["b"][0])
    if prior is not None and 0 < sampled < 1 and 0 < prior < 1:  # from the sample's class balance to the labels'
        bias += np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))
    return Model(weight, bias)


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[bytes, int]]:
    """(text, label) of at most ``max_rows`` labelled rows and half of ``max_bytes`` of text of each class."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label IN (0, 1)").where(~held_out())
    counts = known.groupBy("doc_id").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)])
    # rows are chosen by hash and size before any text is fetched
    rows = scratch.table(sized(docs).join(counts, "doc_id").withColumn("place", F.xxhash64("doc_id")), "sized")
    chosen = []
    for c in (0, 1):
        first = rows.where(F.col(f"n{c}") > 0).orderBy(*sample_order(max_bytes // 2)).limit(max_rows).collect()
        first = [row for row in first for _ in range(min(row[f"n{c}"], max_rows))][:max_rows]
        chosen += [(row["place"], row["doc_id"], row["text_hash"], c)
                   for row in map(first.__getitem__, fitting([row["size"] for row in first], max_bytes // 2))]
    scratch.release()
    texts = texts_of(docs, {(doc_id, text_hash) for _, doc_id, text_hash, _ in chosen})
    return [(texts[doc_id, text_hash], c) for _, doc_id, text_hash, c in sorted(chosen)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on the bounded sample."""
    rows = sample(docs, labels, max_rows, max_bytes)
    usable = labels.where("toxic IN (0, 1)").where(~held_out())
    prior = usable.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return train([t for t, _ in rows], np.array([y for _, y in rows]), prior=prior)


def score(docs: DataFrame, model: Model, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """The given columns of ``docs`` with ``name``, the probability that the text is toxic.

    ``name`` must differ from the columns kept; other names in ``docs`` do not matter.
    """
    columns = ["doc_id"] if columns is None else columns
    text, = free_names(columns, "text")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weight, model.bias))  # BUCKETS numbers, whatever the corpus
    schema = docs.select(*columns).withColumn(name, F.lit(0.0)).schema
    # a text that is kept anyway crosses to the task once, not a second time as bytes
    at = columns.index("text") if "text" in columns and docs.schema["text"].dataType == T.StringType() else None
    given = docs.select(*columns) if at is not None else docs.select(*columns, utf8().alias(text))
    at, width = len(columns) if at is None else at, len(columns)

    def run(batches):
        weight, bias = sent.value
        learned, cache = Model(weight, bias), {}
        for batch in batches:
            scores = np.empty(batch.num_rows)
            for a in range(0, batch.num_rows, 256):
                bags = [set(tokens(t)) for t in batch.column(at).slice(a, 256).cast(pa.large_binary()).to_pylist()]
                if len(cache) > CACHED_WORDS:
                    cache.clear()
                new = list({w for bag in bags for w in bag if w not in cache})
                cache.update(zip(new, learned.words(new).tolist()))
                for i, bag in enumerate(bags):
                    scores[a + i] = sum(map(cache.__getitem__, bag)) / (len(bag) + PAD)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(scores + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(p)], names=[*batch.schema.names[:width], name])

    return given.mapInArrow(run, schema)
