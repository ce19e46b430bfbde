"""Column names of the user's tables, edit budgets, letters, and the mix in the order of its schedule."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dxlens.llm import common, decontaminate, langid, mixing, simhash, toxicity

CLASHING = ("score", "_text", "text_hash", "_hash", "_twin", "twin", "_size", "size", "_taken", "taken", "slots", "slot", "pass", "_pass", "_r_doc_id",
            "root", "fp", "number", "Score")


@pytest.fixture(scope="module")
def clashing_docs(spark):
    names = [n for n in CLASHING if n != "Score"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", f"w{i}"]) for _ in range(30)), "en", f"s{i % 2}", 1, *[f"{n}-{i}" for n in names]) for i in range(40)]
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame(rows, fields)


def same_extras(out, docs):
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in out.collect()}
    want = {r["doc_id"]: tuple(r[c] for c in names) for r in docs.collect()}
    assert out.columns == docs.columns and got and all(want[k] == v for k, v in got.items())


def test_free_names():
    assert common.free_names(["a", "_A"], "a", "b", "b") == ["__a", "b", "_b"]


def test_pipeline_stages_keep_columns_of_any_name(spark, clashing_docs):
    docs = clashing_docs
    same_extras(simhash.representatives(docs, shingle_words=4, max_bits=4), docs)
    same_extras(mixing.mixed_documents(docs), docs)
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    model = toxicity.fit(docs, labels)
    name, = common.free_names(docs.columns, "score")
    scored = toxicity.score(docs, model, docs.columns, name)
    assert name not in docs.columns and scored.count() == 40
    same_extras(scored.drop(name), docs)
    benchmark = spark.createDataFrame([(1, "nothing of the kind stands there")], "item_id long, text string")
    same_extras(decontaminate.clean_documents(docs, benchmark), docs)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"


def test_a_replaced_word_of_an_item_is_within_its_tenth(spark, make_docs):
    item = "the annual report of the board lists all members and their shares in the company"
    assert decontaminate.budget(82, decontaminate.ERROR_RATE, decontaminate.MIN_PIECE) == 8
    rows = [(1, f"some filler {item.replace('annual', 'yearly')} more filler"), (2, "the annual report of another board")]
    benchmark = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminations(make_docs(rows), benchmark).collect()] == [(1, 5)]


def test_items_found_equal_all_pairs(spark, make_docs):
    """Every (document, item) with an approximate occurrence within the budget, against dynamic programming."""
    rng = random.Random(6)

    def nearest(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for c in text:
            before, row[0] = row[0], 0
            for i, x in enumerate(item, 1):
                before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != c))
            best = min(best, row[-1])
        return best

    items = [(i, "".join(rng.choice("abc ") for _ in range(rng.choice([12, 25, 40]))).strip()) for i in range(12)]
    rows = []
    for i in range(40):
        body = list(items[i % 12][1])
        for _ in range(rng.randint(0, 6)):
            body[rng.randrange(len(body))] = rng.choice(["", "a", "bc"])
        rows.append((i, "".join(rng.choice("xyz ") for _ in range(30)) + "".join(body) + "".join(rng.choice("xyz ") for _ in range(20))))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(make_docs(rows), benchmark).collect()}
    want = set()
    for d, text in rows:
        for i, item in items:
            a = decontaminate.normalise(item.encode())
            if nearest(a, decontaminate.normalise(text.encode())) <= int(len(a) * 0.1):
                want.add((d, i))
    assert found == want and len(want) > 10


def test_texts_of_number_characters_have_no_language(make_docs):
    rows = [(i, f"the house and the tree {i}", "en") for i in range(8)] + [(i, f"das haus und der baum {i}", "de") for i in range(8, 16)]
    docs = make_docs(rows)
    model = langid.fit(docs)
    texts = ["½ ² ①", "Ⅷ", "12 34", "_", "٣", "ª", "x"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(make_docs(list(enumerate(texts))), model).collect()}
    assert [got[i] == "und" for i in range(7)] == [True] * 5 + [False] * 2


def test_the_mix_holds_its_sources_in_proportion_from_the_start(make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(5, 15)), "en", "abc"[i % 3]) for i in range(900)]
    out = mixing.mixed_documents(make_docs(rows), position="at", block_words=32).select("at", "source", "text").collect()
    assert all(r["at"] is not None for r in out)
    out.sort(key=lambda r: r["at"])
    total = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in "abc"}
    for part in (4, 2):
        seen = out[:len(out) // part]
        for s in "abc":
            held = sum(len(r["text"].split()) for r in seen if r["source"] == s)
            assert abs(held - total[s] / part) < 0.12 * total[s]
    # the rows of mixed_documents without the column come in the same order
    rows = mixing.mixed_documents(make_docs(rows), block_words=32).select("source").collect()
    assert abs(sum(r["source"] == "c" for r in rows[:300]) - 300 * total["c"] / sum(total.values())) < 40
