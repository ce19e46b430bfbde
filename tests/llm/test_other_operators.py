"""The other operators against brute force, round trips or held-out accuracy, and their edge cases."""

import base64
import hashlib
import json
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from dxlens.llm import ann, common, decontaminate, langid, mixing, simhash, subwords, token_files, toxicity, warc
from dxlens.llm.queries import END_ID, tokenizer_path

PAGES = "page_id long, url string, html string, archive string, sha long"


# WARC

def brute_warc(rows):
    out = []
    for page, _, html in rows:
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=None)
        body = (html or "").encode()
        response = page == top or (top is None)
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


PAGE_ROWS = [(1, "http://b.org/x y", "<p>a\r\n\r\nb</p>"), (2, "https://www.a.org/?q=1", "same"), (3, "a.org", "same"), (4, None, None),
             (5, "", ""), (9, "http://a.org/é\r\nX: 1", "same"), (None, "http://[bad", "same"), (7, "http://a.org", "x" * 300_000),
             (9, "http://a.org/2", "same"), (-3, "http://a.org/3", "\x00ünï")]


def warc_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGE_ROWS], PAGES)
    assert warc_rows(warc.archive_and_index(pages)) == brute_warc(PAGE_ROWS)
    assert warc.archive_and_index(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_histories_are_globally_ordered_over_several_passes(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.org/{rng.randint(0, 9)}", f"page {i // 2}") for i in range(9000)]
    scratch = common.Scratch(spark, "t")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    archives = scratch.table(warc.write_archives(pages, scratch.path("a"), archive_records=400), "m")
    blocks = scratch.table(warc.index_archives(archives, scratch.path("r")), "b")
    assert blocks.select("run").distinct().count() > 9
    merged = warc.merge_runs(blocks, scratch, fan_in=4, blocks_per_range=1)
    reader = common.RangeReader()
    lines = [x for b in sorted(merged.collect(), key=lambda b: b["seq"])
             for x in zlib.decompress(reader.read(b["file"], b["offset"], b["length"])).split(b"\n")]
    order = [(c["urlkey"], c["timestamp"], c["page_id"]) for c in (json.loads(x[x.index(b" {"):]) for x in lines)]
    assert warc.captures(merged).count() == 9000
    assert order == sorted(order) and sorted(p for *_, p in order) == list(range(9000))


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(8):
        runs = [sorted(b"%d" % rng.randint(0, 50) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# mixing

def test_mixing_targets_limits_and_reruns(spark, make_docs):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["big"] * 6 + ["a", "b", None])) for i in range(300)]
    got = mixing.mix(make_docs(rows), block_words=16).collect()
    assert len(got) == 300 and all(r.taken <= 3 * r.size for r in got)
    taken, targets = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = (r.target, r.source_size)
    total = sum(s for _, s in targets.values())
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    assert all(abs(taken[s] - t) < 1 and t <= 3 * n for s, (t, n) in targets.items())
    again = mixing.mix(make_docs(rows[::-1]).repartition(7), block_words=16).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixing_schedule_is_spread_out(spark):
    sources = spark.createDataFrame([(0, 1000, 0, 500), (1, 3000, 0, 3000), (2, 500, 2, 100)], "number long, source_size long, full long, rest long")
    slots = sorted(mixing.schedule(sources, common.Scratch(spark, "t"), 10).collect(), key=lambda r: r.t)
    assert [sum(1 for r in slots if r.number == n) for n in (0, 1, 2)] == [50, 300, 110]
    assert [r["rank"] for r in slots if r.number == 1] == list(range(300))
    half = slots[:len(slots) // 2]
    assert all(abs(sum(1 for r in half if r.number == n) - c / 2) <= 6 for n, c in ((0, 50), (1, 300), (2, 110)))


def test_mixing_edge_cases(edge_docs, make_docs):
    got = mixing.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.taken == 0 for r in got if r.size == 0)
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    assert sum(len(r.text.encode().split()) for r in out.collect()) == sum(r.taken for r in got)
    assert mixing.mixed_documents(make_docs([])).count() == 0 == mixing.mix(make_docs([])).count()
    assert mixing.mix(make_docs([(1, None), (2, " ")])).count() == 2


# SimHash

def brute_fingerprint(text, n=4):
    words = [w.encode().lower().decode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(values)), 2):
        if near(values[i], values[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("partitions", [2, 3, 5])
def test_simhash_components(make_docs, partitions):
    rng = random.Random(partitions)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(150)] for _ in range(8)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(150)] = "CHANGED"
        rows.append((i, " ".join(words)))
    rows += [(60, None), (61, " "), (62, "one two"), (63, "One TWO")]
    got = {r.doc_id: r for r in simhash.near_duplicates(make_docs(rows), partitions=partitions).collect()}
    prints = [brute_fingerprint(t) for _, t in rows]
    assert [got[i].fp % (1 << 64) for i in range(64)] == prints
    assert [got[i].component_id for i in range(64)] == roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)


def test_simhash_links_are_complete(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(-2**63, 2**63, 30)
    values = {int(c) for c in centre}
    for c in centre:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            values.add(int(np.int64(c) ^ np.bitwise_xor.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64))).view(np.int64)))
    classes = spark.createDataFrame([(v,) for v in values], "fp long")
    expected = {(a, b) for a, b in combinations(sorted(values), 2) if ((a ^ b) % (1 << 64)).bit_count() <= 4}
    for partitions in (2, 3, 4):
        parts = simhash.plan(classes, 4, partitions)
        assert sum(t + 1 for _, t in parts) == 5 and sorted(b for g, _ in parts for b in g) == list(range(64))
        assert {(r.a, r.b) for r in simhash.links(classes, parts, 4).collect()} == expected


def test_simhash_long_chain_and_edge_cases(spark, edge_docs, make_docs):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges, common.Scratch(spark, "t")).collect()}
    assert found == {i: 0 for i in range(1, 71)} | {201: 200}
    assert simhash.near_duplicates(edge_docs).count() == edge_docs.count()
    kept = simhash.representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, 2, -7, 5, 2**62, None], key=repr)
    assert simhash.representatives(make_docs([])).count() == 0


def test_threshold_allocation_is_optimal():
    rng = random.Random(3)
    for _ in range(30):
        costs = [[0.0, *sorted(rng.random() for _ in range(5))] for _ in range(rng.randint(2, 5))]
        chosen = simhash.allocate(costs, 4)
        best = min(sum(c[u] for c, u in zip(costs, units)) for units in _splits(5, len(costs)))
        assert sum(c[t + 1] for c, t in zip(costs, chosen)) == pytest.approx(best)


def _splits(total, parts):
    if parts == 1:
        yield (total,) if total <= 5 else ()
        return
    for first in range(total + 1):
        for rest in _splits(total - first, parts - 1):
            yield (first, *rest)


# nearest neighbours

def test_neighbours_recall_ties_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[2000:] = x[2000] + rng.normal(scale=0.01, size=(1000, 24))  # a crowd
    x[100:108] = x[100]  # exact copies: ties to the smaller id
    x[108] = 2 * x[100]  # twice the vector scores exactly the same
    rows = [(i, [float(v) for v in r], "t") for i, r in enumerate(x)]
    odd = [(9000, None, "t"), (9050, [0.0] * 24, "t"), (9100, [float("nan")] * 24, "t"), (9150, [None] * 24, "t"), (9200, [1.0], "t"),
           (9250, [float("inf")] * 24, "t"), (None, [1.0] * 24, "t"), (9300, [], "t")]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    got = {}
    found = ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5, rows_per_shard=700, min_candidates=128, query_block=25)
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 50))
    hits = 0
    norm = np.sqrt((x * x).sum(axis=1))
    for q, out in got.items():
        cosine = (x * x[q]).sum(axis=1) / (norm * norm[q])
        cosine[q] = -9
        best = np.lexsort((np.arange(3000), -cosine))[:5]
        hits += len({v for _, v, _ in out} & set(best.tolist()))
        assert [n for n, *_ in sorted(out)] == [1, 2, 3, 4, 5]
        assert all(cosine[v] == pytest.approx(s, abs=1e-12) for _, v, s in out)
    assert hits / (5 * len(got)) >= 0.9
    assert [v for _, v, _ in sorted(got[100])] == [101, 102, 103, 104, 105]
    few = spark.createDataFrame(rows[:3], vectors.schema)
    assert ann.nearest(few, few.where("vec_id = 0"), 5).count() == 2
    none = vectors.where("vec_id < -1")
    assert ann.nearest(none, none, 5).count() == 0 == ann.nearest(vectors, none, 5).count()


# decontamination

def test_edit_distance_matches_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 25)))
        row, best = list(range(len(item) + 1)), (len(item), 0)
        for j, c in enumerate(text):
            new = [0]
            for i, x in enumerate(item):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[-1] + 1))
            row = new
            if row[-1] < best[0]:
                best = (row[-1], j + 1)
        assert decontaminate.best_match(len(item), decontaminate.masks(item), text) == best


def test_planted_items_are_found_within_the_budget(spark, make_docs, edge_docs):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(35))) for i in range(20)] + [(90, None), (91, ""), (92, "tiny"), (None, " ".join(word() for _ in range(30)))]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, planted = [], set()
    for i in range(60):
        item, text = items[i % 20]
        edits = [0, 3, len(text) // 10 - 5, 60][i % 4]  # an edit may add a letter and change the cost of the blank beside it
        body = list(text)
        for at in rng.sample(range(1, len(body) - 1), edits):
            body[at] = rng.choice(["", "Z", body[at] + "q"])
        rows.append((i, f"{filler(30)}\n {''.join(body).upper()} {filler(40)}"))
        if edits < 60:
            planted.add((i, item))
    rows.append((70, filler(300)))
    benchmark = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    for block in (1 << 20, 600):
        found = decontaminate.contaminations(make_docs(rows), benchmark, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in found} == planted
        assert all(r.distance <= r.budget for r in found)
    kept = decontaminate.clean_documents(make_docs(rows), benchmark, block_bytes=600)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in planted}
    assert decontaminate.clean_documents(edge_docs, benchmark).count() == edge_docs.count()
    none = benchmark.where("item_id < 0")
    assert decontaminate.contaminations(edge_docs, none).count() == 0 == decontaminate.contaminations(make_docs([]), benchmark).count()


def test_upper_cased_copies_of_any_script_are_found(spark, make_docs):
    items = [(0, "L'été où l'élève français a goûté la crème brûlée à Orléans était très agréable"),
             (1, "съешь же ещё этих мягких французских булок да выпей чаю"), (2, "η γρήγορη αλεπού πηδά πάνω από τους σκύλους")]
    rows = [(i, f"some filler {text.upper()} more filler") for i, text in items] + [(3, "ΝΟΤΗΙΝΓ of the kind БУЛОК")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminations(make_docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (1, 1), (2, 2)}
    assert [r.distance for r in found if r.doc_id < 2] == [0, 0]
    assert [r.doc_id for r in decontaminate.clean_documents(make_docs(rows), benchmark).collect()] == [3]
    assert decontaminate.normalise(b"\xff A\xc3\x89\n b") == "\ufffd aé b".encode()


def test_an_item_without_its_first_byte_is_found_at_the_start_of_a_text(spark, make_docs):
    item = '"the quick brown fox jumps over the lazy dog and runs away from the slow bear'
    rows = [(1, item[1:] + " and more text"), (2, " \n " + item[1:]), (3, "x" + item[1:]), (4, item[2:]), (5, "other text")]
    benchmark = spark.createDataFrame([(7, item)], "item_id long, text string")
    found = sorted(decontaminate.contaminations(make_docs(rows), benchmark).collect())
    assert [(r.doc_id, r.distance, r.start) for r in found] == [(1, 1, 0), (2, 1, 0), (3, 1, 1), (4, 2, 0)]
    assert [r.doc_id for r in decontaminate.clean_documents(make_docs(rows), benchmark).collect()] == [5]


# classifiers

def test_languages_on_held_out_documents(spark, make_docs, edge_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs, max_rows=60)).join(docs.select("doc_id", "lang"), "doc_id")
    held = [r for r in out.where(subwords.held_out()).collect()]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in held)
    model = langid.fit(docs, max_rows=40)
    edge = langid.identify(edge_docs, model).collect()
    assert len(edge) == edge_docs.count()
    assert {r.lang_pred for r in edge if r.doc_id in (2, 3, 4)} == {"und"}
    assert langid.identify(make_docs([]), model).count() == 0
    unlearned = langid.fit(make_docs([(1, "text", None)]))
    assert [r.lang_pred for r in langid.identify(make_docs([(1, "text")]), unlearned).collect()] == ["und"]


def test_languages_outside_the_family_table_and_single_ones():
    model = langid.train([b"aaa bbb", b"xxx yyy", b"ppp qqq", b"ppq pqq"], ["xx", "yy", "pt", "pt"])
    assert sorted(map(tuple, model.families)) == [("pt",), ("xx",), ("yy",)]
    for text, code in ((b"aaa", "xx"), (b"yyy", "yy"), (b"ppp", "pt")):
        assert model.decide(model.words([text])[0] + model.bias)[0] == code
    assert langid.train([b"a"], ["en"]).decide(np.array([1.0])) == ("en", 1.0)


def test_a_long_text_does_not_end_the_sample_of_its_language(spark, make_docs):
    words = {"aa": "mala pona telo", "bb": "grumm vextor krank"}
    rows = [(i, f"{words[x]} {words[x][:4]}{i % 5}", x) for i in range(120) for x in (("aa", "bb")[i % 2],)]
    order = make_docs(rows).where(~subwords.held_out()).selectExpr("doc_id", "lang", "xxhash64(doc_id) AS h").orderBy("h").collect()
    first = next(r.doc_id for r in order if r.lang == "bb")
    docs = make_docs([(i, t + " grumm" * 2000 if i == first else t, x) for i, t, x in rows])
    taken = langid.sample(docs, max_bytes=8000)
    assert [sum(x == y for _, y in taken) for x in ("aa", "bb")] == [sum(r.lang == x for r in order) - (x == "bb") for x in ("aa", "bb")]
    model = langid.fit(docs, max_bytes=8000)
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert found == {i: x for i, _, x in rows}
    long = make_docs([(i, "x " * (9000 + i), "aa") for i in range(20)] + [(i, "short", "bb") for i in range(20, 40)] * 2)
    kept = langid.sample(long, max_bytes=8000)
    ids = [r.doc_id for r in order]
    assert [len(t) for t, x in kept if x == "aa"] == [2 * (9000 + min(ids))]
    assert sum(x == "bb" for _, x in kept) == 2 * sum(20 <= i < 40 for i in ids)


def test_toxicity_learns_stems_and_misspellings(spark, make_docs, edge_docs):
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("ren", "tor", "mal", "sin", "pod") for b in ("a", "ot", "ik", "ul", "es", "ar")]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if i % 5 == 0:
            words[3] = words[9] = rng.choice(["grumbok", "grumbol", "grumbek", "vextrash"]) + rng.choice(["", "a", "."])
        rows.append((i, " ".join(words)))
        labels.append((i, i % 2, int(i % 5 == 0)))
    docs, labelled = make_docs(rows), spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labelled)
    held = {r.doc_id: r.score for r in toxicity.score(docs, model).where(subwords.held_out()).collect()}
    right = [(s >= toxicity.THRESHOLD) == (i % 5 == 0) for i, s in held.items()]
    assert sum(right) / len(right) > 0.95
    probe = toxicity.score(make_docs([(1, " ".join(plain[:20] + ["grumbokz", "grumb0k"])), (2, " ".join(plain[:22]))]), model).collect()
    assert {r.doc_id: r.score for r in probe}[1] > 2 * {r.doc_id: r.score for r in probe}[2]
    edge = toxicity.score(edge_docs, model).collect()
    assert len(edge) == edge_docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score(make_docs([]), model).count() == 0
    nothing = toxicity.fit(docs, labelled.where("doc_id < -1"))
    assert {r.score for r in toxicity.score(edge_docs, nothing).collect()} == {0.0}


def test_a_long_labelled_text_does_not_end_its_class(spark, make_docs):
    rows = [(i, f"plain words here w{i % 7} " + ("grumbok" if i % 2 else "harmless")) for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    order = spark.createDataFrame(labels, "doc_id long, toxic int").where(~subwords.held_out()).selectExpr("doc_id", "xxhash64(doc_id) AS h").orderBy("h").collect()
    for c in (0, 1):
        first = next(r.doc_id for r in order if r.doc_id % 2 == c)
        docs = make_docs([(i, t + " long" * 2000 if i == first else t) for i, t in rows])
        labelled = spark.createDataFrame(labels, "doc_id long, toxic int")
        taken = toxicity.sample(docs, labelled, max_bytes=16_000)
        assert [sum(y == k for _, y in taken) for k in (0, 1)] == [sum(r.doc_id % 2 == k for r in order) - (k == c) for k in (0, 1)]
        model = toxicity.fit(docs, labelled, max_bytes=16_000)
        held = toxicity.score(docs, model).where(subwords.held_out()).collect()
        assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in held if r.doc_id != first)
    # all texts of a class over the bound: its shortest is kept; equal rows count each
    long = make_docs([(i, "x " * (9000 + i) if i % 2 else "short") for i in range(40)] * 2)
    kept = toxicity.sample(long, labelled, max_bytes=16_000)
    ids = [r.doc_id for r in order if r.doc_id < 40]
    assert [len(t) for t, y in kept if y] == [2 * (9000 + min(i for i in ids if i % 2))]
    assert sum(not y for _, y in kept) == 2 * sum(i % 2 == 0 for i in ids)
    assert len(toxicity.sample(long, labelled, max_rows=5)) == 10


# token files

def test_tokens_round_trip(spark, edge_docs, make_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    letters = "aAbBßÉéİıΣσςſ²½1.,!?'ś  \x0b\x0c\n\t  Å가각ñ_-#😀"
    rows = [(i // 2, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(7, "same"), (7, "same"), (7, None)] + [(r.doc_id, r.text) for r in edge_docs.collect()]
    store = token_files.write_store(make_docs(rows).repartition(5), tokenizer_path(), END_ID, keys_per_shard=50)
    got = sorted(token_files.read_ids(store).collect(), key=lambda r: r.start)
    expected = {}
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID]
        expected.setdefault(doc, []).append(ids)
    found, at = {}, 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
        found.setdefault(r.doc_id, []).append(ids)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    one = token_files.read_ids(store, spark.createDataFrame([(3, 1), (3, 9), (-55, 0)], "doc_id long, occurrence long")).collect()
    assert len(one) == 1 and np.frombuffer(bytes(one[0].ids), "<u4").tolist() in expected[3]
    empty = token_files.write_store(make_docs([]), tokenizer_path(), END_ID)
    assert token_files.read_ids(empty).count() == 0


def test_occurrences_continue_over_shards(spark):
    entries = spark.createDataFrame([("f", s, d, o, o, 1) for s, d, o in
                                     [(0, 1, 0), (0, 5, 0), (0, 5, 1), (1, 5, 0), (1, 5, 1), (2, 5, 0), (2, 8, 0)]],
                                    "file string, shard long, doc_id long, occurrence long, offset long, n_tokens long")
    entries = entries.withColumn("offset", entries.occurrence + 10 * (entries.doc_id == 5).cast("long") + 20 * (entries.doc_id == 8).cast("long"))
    found = sorted((r.doc_id, r.occurrence) for r in token_files._continued(entries).collect())
    assert found == [(1, 0), (5, 0), (5, 1), (5, 2), (5, 3), (5, 4), (8, 0)]


def test_crc_of_ids_matches_the_contract():
    ids = np.array([1, 40_000, END_ID], "<u4")
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(b"\x01\0\0\0\x40\x9c\0\0\x02\0\0\0")
