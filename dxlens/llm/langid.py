"""Language identification: the family first, then one-versus-one linear SVMs within it.

A text's features are the mean over its different words of their hashed
subwords.  One linear SVM per family, against the rest, picks the family; inside a
family one SVM per pair of languages votes, ties going to the larger sum of margins and
then to the smaller code.  All machines are trained together in numpy (squared hinge, L2, full-batch Adam) on a
bounded sample of labelled rows: per language the ``max_rows`` rows first by a hash of
their doc_id, texts over 1/32 of ``max_bytes`` after all others; of these, in order, each that still fits into
``max_bytes``, and the first one always.  Sizes decide before texts are fetched.  Being linear, they score a word once; tasks remember its margins.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows with a
null lang or a null doc_id are predicted, never learned from; a language outside the family table is a family of its own; with no
usable labels all is ``und``; repeated rows are learned and predicted each on its own; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dxlens.llm.common import utf8
from dxlens.llm.subwords import BUCKETS, Bags, fitting, held_out, sample_order, sized, subwords, texts_of, tokens

# fixed values: language codes by family
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNKNOWN = "und"
MAX_ROWS = 500
CELLS = 16
MAX_BYTES = 3 << 19
STEPS = 60
RATE = 0.5
RIDGE = 1e-6
CACHED_WORDS = 1 << 18
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """``weight``: buckets x machines; ``bias``: per machine; machines are the families, then the pairs."""

    languages: list[str]
    families: list[list[str]]
    pairs: list[tuple[str, str]]
    weight: np.ndarray
    bias: np.ndarray

    def words(self, words: list[bytes]) -> np.ndarray:
        """The machines' margins of each word."""
        if not words or not len(self.bias):
            return np.zeros((len(words), len(self.bias)), np.float32)
        buckets, starts = subwords(words)
        sizes = np.diff([*starts, len(buckets)])
        return np.stack([np.add.reduceat(self.weight[:, k][buckets], starts) / sizes for k in range(len(self.bias))],
                        axis=1).astype(np.float32)

    def decide(self, margins: np.ndarray) -> tuple[str, float]:
        """(language, score) from a text's margins."""
        count = len(self.families)
        odds = np.exp(2 * (margins[:count] - margins[:count].max()))
        best = int(margins[:count].argmax())
        family, share = self.families[best], float(odds[best] / odds.sum())
        votes, sums, chance = dict.fromkeys(family, 0), dict.fromkeys(family, 0.0), dict.fromkeys(family, 1.0)
        for (a, b), m in zip(self.pairs, margins[count:]):
            if a in votes and b in votes:
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
                p = float(1 / (1 + np.exp(-np.clip(2 * m, -60, 60))))
                chance[a], chance[b] = min(chance[a], p), min(chance[b], 1 - p)
        winner = min(family, key=lambda x: (-votes[x], -sums[x], x))
        return winner, share * chance[winner]


def train(texts: list[bytes], languages: list[str], families: dict[str, tuple[str, ...]] | None = None,
          steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    known = sorted(set(languages))
    family_of = {code: name for name, codes in (FAMILIES if families is None else families).items() for code in codes}
    names = sorted({family_of.get(x, x) for x in known})
    groups = [[x for x in known if family_of.get(x, x) == name] for name in names]
    pairs = [p for g in groups for p in combinations(g, 2)]
    machines = len(groups) + len(pairs)
    # +1, -1, or 0 where a machine does not see the text
    row = {x: [1 if x in g else -1 for g in groups] + [1 if x == a else -1 if x == b else 0 for a, b in pairs] for x in known}
    target = np.array([row[x] for x in languages], np.float32).reshape(len(languages), machines)
    vocabulary: dict[bytes, int] = {}
    bags = [[vocabulary.setdefault(w, len(vocabulary)) for w in sorted(set(tokens(t)))] for t in texts]
    buckets, starts = subwords(list(vocabulary)) if vocabulary else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = np.diff([*starts, len(buckets)])
    used, column = np.unique(buckets, return_inverse=True)
    grams = Bags(np.repeat(np.arange(len(vocabulary)), sizes), column, np.repeat(1 / np.maximum(sizes, 1), sizes).astype(np.float32),
                 len(vocabulary), len(used))
    lengths = [len(b) for b in bags]
    texts_words = Bags(np.repeat(np.arange(len(bags)), lengths), np.fromiter((w for b in bags for w in b), np.int64, sum(lengths)),
                       np.repeat([1 / max(n, 1) for n in lengths], lengths).astype(np.float32), len(bags), len(vocabulary))
    seen = np.maximum(np.abs(target).sum(axis=0), 1)
    w, b = np.zeros((len(used), machines), np.float32), np.zeros(machines, np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        margin = texts_words.forward(grams.forward(w)) + b
        error = (-2 * target * np.maximum(0, 1 - target * margin) / seen).astype(np.float32)
        gradients = (grams.backward(texts_words.backward(error)) + ridge * w, error.sum(axis=0))
        scale = rate * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        for i, (value, g) in enumerate(zip((w, b), gradients)):
            m, v = state[2 * i], state[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            # a floor on the step's divisor keeps rare buckets from steps as long as the telling ones'
            value -= (scale * m / (np.sqrt(v) + 0.05 * np.sqrt(v.max(initial=0)) + 1e-12)).astype(np.float32)
    weight = np.zeros((BUCKETS, machines), np.float32)
    weight[used] = w
    return Model(known, groups, pairs, weight, b)


def sample(docs: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[bytes, str]]:
    """(text, lang): per language at most ``max_rows`` rows and ``max_bytes`` of text that may be learned from."""
    # rows are chosen by hash and size before any text is fetched
    known = sized(docs, "lang").where("lang IS NOT NULL")
    order = sample_order(max_bytes)
    # first within cells of a language, so that the last selection meets CELLS * max_rows ids of it at most
    known = known.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CELLS)))
    for cell in (["lang", "cell"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*cell).orderBy(*order))
        known = known.withColumn("place", place).where(F.col("place") <= max_rows)
    first: dict[str, list] = {}
    for row in known.withColumn("hash", F.xxhash64("doc_id")).collect():  # max_rows a language
        first.setdefault(row["lang"], []).append(row)
    chosen = []
    for lang, rows in first.items():
        rows.sort(key=lambda row: row["place"])
        chosen += [(lang, row["hash"], row["doc_id"], row["text_hash"])
                   for row in map(rows.__getitem__, fitting([row["size"] for row in rows], max_bytes))]
    texts = texts_of(docs, {(doc_id, text_hash) for *_, doc_id, text_hash in chosen})
    return [(texts[doc_id, text_hash], lang) for lang, _, doc_id, text_hash in sorted(chosen)]


def fit(docs: DataFrame, families: dict[str, tuple[str, ...]] | None = None, max_rows: int = MAX_ROWS,
        max_bytes: int = MAX_BYTES) -> Model:
    """Train on the bounded sample."""
    rows = sample(docs, max_rows, max_bytes)
    return train([t for t, _ in rows], [x for _, x in rows], families)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the corpus

    def run(batches):
        learned: Model = sent.value
        cache: dict[bytes, int] = {}
        table = np.zeros((0, len(learned.bias)), np.float32)
        for batch in batches:
            found = []
            for a in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(a, 256).to_pylist()
                bags = [set(tokens(t)) for t in texts]
                if len(cache) > CACHED_WORDS:
                    cache, table = {}, table[:0]
                new = list({w for bag in bags for w in bag if w not in cache})
                cache.update(zip(new, range(len(cache), len(cache) + len(new))))
                table = np.concatenate([table, learned.words(new)])
                for text, bag in zip(texts, bags):
                    if not learned.languages or not text or not LETTER.search(text.decode("utf-8", "replace")):
                        found.append((UNKNOWN, 0.0))
                    else:
                        margins = table[list(map(cache.__getitem__, bag))].mean(axis=0, dtype=np.float64) + learned.bias
                        found.append(learned.decide(margins))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    rows = docs.select(utf8().alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
