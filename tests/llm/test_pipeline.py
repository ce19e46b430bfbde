"""The pipeline's stages against brute force on a small table, and its registration."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from dxlens.llm import decontaminate, subwords, toxicity
from dxlens.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_other_operators import brute_fingerprint, roots

STEMS = ("grumbok", "grumbek", "vextrash")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = [f"{a}{b}" for a in ("ren", "tor", "mal", "sin", "pod", "kel", "vam") for b in ("a", "ot", "ik", "ul", "es", "ar")]
    item = " ".join(rng.choice(plain) + str(i) for i in range(30))
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            for at in (2, 7, 11):
                words[at] = rng.choice(STEMS) + rng.choice(["", "a", "s"])
        if i % 50 == 7:
            words[5:5] = item.split()
        text = " ".join(words)
        if i % 40 == 9:
            text = rows[i - 2][1]  # an exact copy
        rows.append((i, text, "en", f"s{i % 4 if i % 3 else 0}", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(600, None, None, None, None), (601, "", "en", "s1", 0), (602, " \n ", "en", None, 3), (None, "no id here at all", "en", "s2", 17)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, item


def test_stages_match_brute_force(spark, corpus, tmp_path):
    folder, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {"documents": docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs.collect()
    before = [r for r in kept["documents"]]
    # toxicity: the model is the operator's own; its scores are recomputed text by text
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        words = sorted(set(subwords.tokens((text or "").encode())))
        return 1 / (1 + np.exp(-(model.words(words).sum() / (len(words) + toxicity.PAD) + model.bias)))

    clean = [r for r in before if score(r.text) < toxicity.THRESHOLD]
    assert sorted(kept["toxicity"], key=repr) == sorted(clean, key=repr)
    toxic = [r for r in before if r.doc_id is not None and r.doc_id < 600 and any(s in r.text for s in STEMS)]
    caught = [r for r in toxic if r not in clean]
    false_alarms = len(before) - len(clean) - len(caught)
    assert len(caught) >= 0.95 * len(toxic) and false_alarms <= 0.02 * (len(before) - len(toxic))
    # near duplicates: the smallest doc_id of each component
    rows = sorted(kept["toxicity"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    first = set(roots([brute_fingerprint(r.text) for r in rows], lambda a, b: (a ^ b).bit_count() <= 4))
    assert sorted(kept["simhash_near_dedup"], key=repr) == sorted((rows[i] for i in first), key=repr)
    # decontamination: the planted item is there as it is
    held = decontaminate.normalise(item.encode())
    assert sorted(kept["benchmark_decontamination"], key=repr) == sorted(
        (r for r in kept["simhash_near_dedup"] if held not in decontaminate.normalise((r.text or "").encode())), key=repr)
    # mixing: sizes near the targets, no document over three times, words in order from the start
    sizes, taken, of = {}, {}, {}
    for r in kept["benchmark_decontamination"]:
        n = len((r.text or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        of[r.doc_id] = r
    times = {}
    for r in kept["source_mixing"]:
        n = len(r.text.split())
        taken[r.source] = taken.get(r.source, 0) + n
        times[r.doc_id] = times.get(r.doc_id, 0) + n
        assert r.text == of[r.doc_id].text or r.text.split() == of[r.doc_id].text.split()[:n]
        assert r.n_chars == len(r.text)
    assert all(n <= 3 * len(of[d].text.split()) for d, n in times.items())
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, open_ = sum(sizes.values()), set(sizes)
    while True:
        left = total - sum(3 * sizes[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: share[s] if s in open_ else 3 * sizes[s] for s in sizes}
    assert all(abs(taken.get(s, 0) - t) < 1 for s, t in target.items())
    # token files
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = {}
    for r in kept["source_mixing"]:
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2]
        expected.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found, at = {}, 0
    for r in sorted(kept["token_files"], key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    # run() gives the last stage's rows
    assert sorted(map(repr, corpus_pipeline.run(spark, folder).collect())) == sorted(map(repr, kept["token_files"]))


def test_empty_tables_go_through(spark, corpus, tmp_path):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < -9")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0


def test_registration():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]
