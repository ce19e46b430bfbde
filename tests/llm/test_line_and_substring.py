"""Line and substring dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from dxlens.llm import line_dedup, mph, substring_dedup
from dxlens.llm.fm_index import FMIndex, WaveletTree

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute_lines(rows, min_chars, min_docs):
    holders = {}
    order = lambda d: (d is not None, d or 0)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(doc)
    drop = {k: max(v, key=order) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in drop or drop[key(x)] == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def lines_of(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 18), (3, 4)])
def test_lines_match_brute_force(make_docs, sizes):
    rng = random.Random(4)
    pool = [f"Line number {i} of the common pool {'é' * (i % 3)}" for i in range(12)] + ["short", "", "  ", "ABCDEFGHIJKLMNOPQRST"]
    vary = lambda x: rng.choice([x, x.upper(), f" \t{x}\r", x])
    rows = [(rng.choice([i, i, 7]), "\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rows += [(None, pool[0]), (None, None), (99, "abcdefghijklmnopqrst"), (98, "abcdefghijklmnopqrst"), (97, "ABCDEFGHIJKLMNOPQRST")]
    got = line_dedup.dedup_lines(make_docs(rows), keys_per_shard=sizes[0], probes_per_task=sizes[1])
    assert lines_of(got) == brute_lines(rows, 20, 3)


def test_line_edge_cases(edge_docs, make_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert lines_of(line_dedup.dedup_lines(edge_docs)) == brute_lines(rows, 20, 3)
    assert lines_of(line_dedup.dedup_lines(make_docs([]))) == []


def test_perfect_hash_is_minimal_and_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 70, 5000):
        a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
        built = mph.MinimalPerfectHash.build(a, b)
        again = mph.MinimalPerfectHash.from_arrays(mph.unpack(mph.pack(**built.to_arrays())))
        assert sorted(again.lookup(a, b)) == list(range(n))


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    sequence = rng.integers(0, 37, 500)
    tree = WaveletTree(sequence, 37)
    symbols, places = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert tree.rank(symbols, places).tolist() == [int((sequence[:p] == s).sum()) for s, p in zip(symbols, places)]


def test_first_occurrences_by_backward_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        k = int(rng.integers(2, 9))
        sizes = rng.integers(1, 20, 12)
        text = np.concatenate([np.append(rng.integers(1, 4, s), 0) for s in sizes])
        starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        first, expected = {}, np.full(len(text), -1)
        for s, size in zip(starts, sizes):
            for i in range(s, s + size - k + 1):
                expected[i] = first.setdefault(tuple(text[i:i + k]), i)
        assert FMIndex(text, k).first_occurrences(text, starts, sizes).tolist() == expected.tolist()


def brute_substrings(rows, window):
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, (_, t) in enumerate(rows)}
    first = {}
    place = lambda i, a: (rows[i][0] is not None, rows[i][0] or 0, i, a)
    for i, words in split.items():
        for a in range(len(words) - window + 1):
            w = tuple(words[a:a + window])
            first[w] = min(first.get(w, place(i, a)), place(i, a))
    out = []
    for i, words in split.items():
        gone = {a + o for a in range(len(words) - window + 1) if first[tuple(words[a:a + window])] < place(i, a) for o in range(window)}
        kept = [w for a, w in enumerate(words) if a not in gone]
        out.append((rows[i][0], " ".join(kept), len(words), len(gone)))
    return sorted(out, key=repr)


def substrings_of(df):
    return sorted(((r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in df.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot_pieces": 3, "pieces_per_shard": 20}, {"pieces_per_shard": 5}])
def test_substrings_match_brute_force(make_docs, options):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        if i % 2:
            a = rng.randint(0, 20)
            words += passage[a:a + rng.randint(5, 20)] + [f"u{i}"]
        rows.append((100 - i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(500, "the " * 90), (501, "x " + "the " * 30), (None, " ".join(passage)), (502, "a b " * 20)]
    got = substring_dedup.dedup_substrings(make_docs(rows), window=7, run=3, **options)
    assert substrings_of(got) == brute_substrings(rows, 7)


def test_substring_edge_cases(edge_docs, make_docs):
    got = substring_dedup.dedup_substrings(edge_docs)
    found = {(r.doc_id, r.n_words): (r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()}
    assert found[(5, 30_000)][0] == 30_000 - 997  # the text repeats itself from word 997 on
    assert found[(6, 30_000)] == (30_000, hashlib.sha256(b"").hexdigest())
    assert found[(2, 0)][0] == found[(3, 0)][0] == found[(4, 0)][0] == 0
    assert found[(1, 6)][0] == 0 and got.count() == edge_docs.count()
    assert substring_dedup.dedup_substrings(make_docs([])).count() == 0
