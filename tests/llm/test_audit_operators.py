"""License scan, periodic runs and source divergence against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from dxlens.llm import divergence, licenses, queries, runs

# periodic runs


def brute_runs(words, min_words=24, min_exponent=3):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_words, min_exponent * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive_words(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.3:
            words += [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        elif kind < 0.8:
            piece = [rng.choice("ab") for _ in range(rng.randint(1, 12))]
            words += (piece * 90)[:rng.randint(1, 90)]
        else:
            words += [str(rng.randint(0, 9)) for _ in range(rng.randint(0, 30))]
        if words and rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)):]
    return [w.encode() for w in words]


@pytest.mark.parametrize("min_words,min_exponent", [(24, 3), (6, 3), (3, 3), (10, 4)])
def test_runs_equal_brute_force(min_words, min_exponent):
    rng = random.Random(min_words)
    for _ in range(300):
        texts = [repetitive_words(rng) for _ in range(rng.randint(1, 4))]
        assert runs.runs_of(texts, min_words, min_exponent) == [brute_runs(t, min_words, min_exponent) for t in texts]


def test_runs_of_long_periodic_text():
    assert runs.runs_of([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]
    assert runs.runs_of([[b"%d" % (i % 777) for i in range(50_000)] + [b"x"]]) == [[(0, 50_000, 777)]]


def expected_runs_row(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n, before = h // 10, len(words), list(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else before[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def run_rows(docs, monkeypatch, spark):
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    return sorted((tuple(r) for r in queries.op12_periodic_runs(spark, "").collect()), key=repr)


def test_runs_query_equals_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(4)
    rows = [(i, b" ".join(repetitive_words(rng)).decode() if i % 3 else " ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(0, 80))))
            for i in range(120)]
    assert run_rows(make_docs(rows), monkeypatch, spark) == sorted((expected_runs_row(*r) for r in rows), key=repr)


def test_runs_edge_cases(spark, make_docs, monkeypatch):
    rows = [(1, None), (None, "a " * 30), (2, ""), (3, " \t\n"), (4, "x y " * 5_000), (4, "x y " * 5_000), (5, "a\x0bb\x0c" * 15),
            (6, "ä ö ü " * 9), (-1, "one"), (7, "A a " * 12)]
    assert run_rows(make_docs(rows), monkeypatch, spark) == sorted((expected_runs_row(*r) for r in rows), key=repr)
    assert run_rows(make_docs([]), monkeypatch, spark) == []


# license scan

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate(str.maketrans(divergence.UPPER, divergence.LOWER))


def brute_scan(rows, anchors=8, slack=8, min_share=0.5):
    """Every alignment of every template with every text, without an index."""
    texts = [TERMS.findall(lowered(t)) for _, t in rows]
    out = []
    holds = Counter(w for t in texts for w in set(t))

    def weight(w):
        return round(10**6 * (1 + math.log((1 + len(texts)) / (1 + holds[w]))))

    for (doc_id, _), words in zip(rows, texts):
        base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split())
        score, labels = 0.0, {label for _, label in base}
        for t in licenses.TEMPLATES:
            own = TERMS.findall(lowered(t.text))
            rare = sorted(set(own), key=lambda w: (-weight(w), w))[:anchors]
            total = sum(map(weight, rare))
            shares = {False: 0.0, True: 0.0}
            hits = {(f - p, w) for f, w in enumerate(words) for p, v in enumerate(own) if v == w and w in rare}
            for a in {a for a, _ in hits}:
                held = sum(weight(w) for w in {w for b, w in hits if a <= b <= a + slack})
                good = held >= min_share * total
                for phrase in t.phrases:
                    phrase = phrase.split()
                    place = next(i for i in range(len(own)) if own[i:i + len(phrase)] == phrase)
                    good = good and any(words[x:x + len(phrase)] == phrase for x in range(max(0, a + place - slack), a + place + 2 * slack + 1))
                shares[good] = max(shares[good], held / total)
            if shares[True]:
                labels.add(t.label)
            score = max(score, shares[True] or shares[False] / 2)
        out.append((doc_id, len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), round(1.0 if base else score, 6)))
    return sorted(out, key=repr)


def scan_rows(docs, monkeypatch, spark):
    monkeypatch.setattr(queries, "read", lambda *_: docs)
    return sorted((tuple(r) for r in queries.op11_license_scan(spark, "").collect()), key=repr)


def test_scan_equals_brute_force(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        words = [rng.choice(["software", "license", "the", "of", "code", "zebra", "mit", "public", "general", "Apache"]) for _ in range(rng.randint(0, 60))]
        for t in rng.sample(licenses.TEMPLATES, rng.randint(0, 2)):
            copied = [w for w in t.text.split() if rng.random() > rng.choice([0, 0, 0.1, 0.4])]
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice([str.upper, str.lower])(w) for w in copied]
        rows.append((i, rng.choice([" ", "\n", " * "]).join(words)))
    assert scan_rows(make_docs(rows), monkeypatch, spark) == brute_scan(rows)


def test_scan_edge_cases(spark, make_docs, monkeypatch):
    rows = [(1, None), (1, ""), (None, "MIT License"), (2, "license " * 3_000), (3, "mit-license\x00apache\nLICENSE"), (3, "mit-license\x00apache\nLICENSE"),
            (4, "ümit license"), (5, "general public license general public licenses"), (6, licenses.TEMPLATES[0].text), (7, "the mit license " * 200)]
    got = scan_rows(make_docs(rows), monkeypatch, spark)
    assert got == brute_scan(rows)
    assert {r[0]: r[6] for r in got}[6] == "mit"
    assert scan_rows(make_docs([]), monkeypatch, spark) == []


# source divergence


def audit(spark, docs, **sizes):
    return sorted(tuple(r) for r in divergence.source_divergence(docs, **sizes).collect())


def oracle_audit(rows, min_docs=10, top=10):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows)
    sql = queries.ORACLE_SQL["op13_source_divergence"].replace(">= 10", f">= {min_docs}").replace("<= 10", f"<= {top}")
    return sorted(con.execute(sql).fetchall())


def brute_audit(rows, min_docs=10, top=10):
    unit = 10**9
    docs = [(lang or "", source or "", re.findall(divergence.TERM_PATTERN, lowered(text))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holds = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in holds.items() if n >= min_docs}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}

        def p(count, t):
            return 1 + unit * (count[t] + 2) // (sum(count.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        whole = sum(counts.values(), Counter())
        for s, count in counts.items():
            pairs = [(o, sum(f(p(count, t), p(counts[o], t)) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p(count, t), p(whole, t))) for t in count if p(count, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ordered)]
    return sorted(out)


def audit_rows(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefé" for b in "xyzİß"]
    rows = []
    for i in range(160):
        text = rng.choice([" ", "\t", "\n "]).join(
            rng.choice([str, str.upper, str.title])(rng.choice(words)) + rng.choice(["", "", ".", "-" + rng.choice(words), "'s", "9"])
            for _ in range(rng.randint(0, 12)))
        rows.append((i, rng.choice([text, text, None if i % 20 == 0 else text]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "ç", None])))
    return rows


@pytest.mark.parametrize("seed,cells,held", [(1, 1 << 20, 1 << 25), (2, 8, 2_000), (3, 1, 1)])
def test_audit_equals_brute_force(spark, make_docs, seed, cells, held):
    rows = audit_rows(seed)
    # little text held and few cells: partial sums, many blocks and tiles
    want = brute_audit(rows)
    assert audit(spark, make_docs(rows).repartition(5), cells=cells, held_bytes=held) == want
    assert oracle_audit(rows) == want


def test_audit_counts_a_document_once_for_terms_in_many_chunks(spark, make_docs):
    # 'end' is in 9 documents, each with several chunks of it; 'far' in 10, by chunks in one document each
    rows = [(i, f"end End. END, end! far{'!' * i}", "en", "ab"[i % 2]) for i in range(9)] + [(9, "FAR?", "en", "a")]
    assert audit(spark, make_docs(rows)) == brute_audit(rows)
    assert {r[3] for r in audit(spark, make_docs(rows)) if r[2] == "term"} <= {"far"}


def test_audit_edge_cases(spark, make_docs):
    rows = [(None, None, None, None)] * 3 + [(1, "", "en", "a"), (1, "123 ...", "en", "b"), (2, "long " * 20_000, "en", ""), (3, "x" * 100_000, "fr", "z")]
    assert audit(spark, make_docs(rows)) == brute_audit(rows)
    assert audit(spark, make_docs(rows), min_docs=1) == brute_audit(rows, min_docs=1)
    assert audit(spark, make_docs([])) == []
