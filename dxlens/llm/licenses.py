"""License scan by a positional index of rare template words.

The corpus says how rare each word of the licence templates is (documents that
hold it, counted over all of them).  Each template's ``anchors`` rarest words are indexed
with their positions in it; a text's highest-IDF licence words are its words that
the index holds, and all their places are looked up.  A text place f and a template
place p give the alignment f - p; within a template, alignments that agree (up
to ``slack`` words, for names and years put in or left out) are intersected: the
share of the template's IDF weight whose words meet there.  An alignment with at least
``min_share`` is verified: every mandatory key phrase must stand, word for
word, where the template puts it (again up to the slack).

Beside this the base phrases are found wherever their words stand consecutively.

A template counts with the share of its best verified alignment, or, where it has none, with
half the share of its best one.  ``score`` is the greatest of these, 1 with a base phrase, 0 without a licence word.

Edge cases: null and empty texts have no words; rows are independent, so repeated
rows and ids count each (also in the document counts); empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dxlens.llm.common import batched, records, utf8

# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters and all bytes beyond ASCII
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WEIGHT_UNIT = 1_000_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]


BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# fixed values: passages of public licences and the phrases that a copy must hold
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
             "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("mit", "Released under the MIT License", ("the mit license",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies",
             ("with or without fee is hereby granted",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer",
             ("redistribution and use in source and binary forms", "redistributions of source code must retain")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
             "promote products derived from this software without specific prior written permission",
             ("endorse or promote products derived from this software",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
             "License. You may obtain a copy of the License at",
             ("the apache license version 2 0", "except in compliance with the license")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("the apache license version 2 0",)),
    Template("gpl-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation, either version 3 of the License, or, at your option, any "
             "later version",
             ("gnu general public license as published by the free software foundation", "any later version")),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
             "not distributed with this file, You can obtain one at",
             ("mozilla public license v 2 0",)),
    Template("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution 4 0 international",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("attribution noncommercial 4 0 international",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("free and unencumbered software released into the public domain",)),
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def vocabulary(templates: tuple[Template, ...]) -> set[bytes]:
    return {w for t in templates for w in split_words(t.text.encode())}


def document_counts(docs: DataFrame, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and for each of ``words`` the documents that hold it; one row a word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                seen.update(words.intersection(split_words(text or b"")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(utf8().alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts.pop(b"", 0), counts


def weights(total: int, counts: dict[bytes, int], words: set[bytes]) -> dict[bytes, int]:
    """1 + ln((1 + documents) / (1 + documents with the word)) in millionths."""
    return {w: round(WEIGHT_UNIT * (1 + math.log((1 + total) / (1 + counts.get(w, 0))))) for w in words}


class Index:
    """Postings (template, position) of each template's rarest words, and what a match must verify."""

    def __init__(self, templates: tuple[Template, ...], weight: dict[bytes, int], anchors: int):
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.weight, self.labels, self.totals, self.phrases = weight, [t.label for t in templates], [], []
        for number, template in enumerate(templates):
            words = split_words(template.text.encode())
            rare = sorted(set(words), key=lambda w: (-weight[w], w))[:anchors]
            self.totals.append(sum(weight[w] for w in rare))
            for place, word in enumerate(words):
                if word in rare:
                    self.postings.setdefault(word, []).append((number, place))
            needed = [split_words(p.encode()) for p in template.phrases]
            self.phrases.append([(p, next(i for i in range(len(words)) if words[i:i + len(p)] == p)) for p in needed])

    def matches(self, words: list[bytes], places: list[int], slack: int, min_share: float) -> list[tuple[str, int, float, bool]]:
        """(label, alignment, share, verified): each template's best verified alignment, or its best one."""
        hits: dict[int, list[tuple[int, bytes]]] = {}
        for f in places:
            for number, p in self.postings.get(words[f], ()):
                hits.setdefault(number, []).append((f - p, words[f]))
        found = []
        for number, at in hits.items():
            at.sort()
            best, inside, held, begin, end = (False, 0, 0), Counter(), 0, 0, 0
            while begin < len(at):
                start = at[begin][0]
                while end < len(at) and at[end][0] <= start + slack:
                    word = at[end][1]
                    held += 0 if inside[word] else self.weight[word]
                    inside[word] += 1
                    end += 1
                verified = held >= min_share * self.totals[number] and self._verified(number, words, start, slack)
                best = max(best, (verified, held, -start))
                while begin < end and at[begin][0] == start:
                    word = at[begin][1]
                    inside[word] -= 1
                    held -= 0 if inside[word] else self.weight[word]
                    begin += 1
            found.append((self.labels[number], -best[2], best[1] / self.totals[number], best[0]))
        return found

    def _verified(self, number: int, words: list[bytes], start: int, slack: int) -> bool:
        def stands(phrase: list[bytes], place: int) -> bool:
            first = max(0, start + place - slack)
            return any(words[x:x + len(phrase)] == phrase for x in range(first, start + place + 2 * slack + 1))

        return all(stands(p, place) for p, place in self.phrases[number])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE,
         anchors: int = 8, slack: int = 8, min_share: float = 0.5) -> DataFrame:
    """doc_id, n_words, base (label, start, stop), matches (label, start, share, verified), score per row of ``docs`` (doc_id, text)."""
    words_of = vocabulary(templates)
    index = Index(templates, weights(*document_counts(docs, words_of), words_of), anchors)
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for phrase, label in base:
        phrase = split_words(phrase.encode())
        phrases.setdefault(phrase[-1], []).append((phrase, label))
    wanted = set(index.postings) | set(phrases)
    base_type = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])
    match_type = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64()), ("verified", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(base_type)), ("matches", pa.list_(match_type)),
                        ("score", pa.float64())])

    def scanned(text: bytes) -> tuple:
        words = split_words(text)
        places = [i for i, w in enumerate(words) if w in wanted]
        if not places:
            return len(words), [], [], 0.0
        stated = [{"label": label, "start": i + 1 - len(phrase), "stop": i + 1} for i in places for phrase, label in phrases.get(words[i], ())
                  if i + 1 >= len(phrase) and words[i + 1 - len(phrase):i + 1] == phrase]
        matches = sorted(index.matches(words, places, slack, min_share))
        score = 1.0 if stated else max((share if verified else share / 2 for _, _, share, verified in matches), default=0.0)
        return len(words), stated, [dict(zip(("label", "start", "share", "verified"), m)) for m in matches], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(((doc_id, *scanned(text or b"")) for doc_id, text in records(batches)), schema)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, base array<struct<label: string, start: long, stop: long>>, "
                             "matches array<struct<label: string, start: long, share: double, verified: boolean>>, score double"))
