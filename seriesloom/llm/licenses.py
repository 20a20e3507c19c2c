"""Licence statements in documents, by a positional index of rare template words.

The postings say at which places of which templates a mandatory word stands. In a document the words of all templates that can stand there (all their mandatory words occur)
are looked up from the highest inverse document frequency on; each look-up gives the shifts of the templates against the text at which the word is in place, and the shifts of a template's
words are intersected. A template takes part until ``looked_up`` of its words have been intersected or no shift is left; it has them all looked up if it has fewer, so the
number decides how many shifts are verified and never which statements are found. At a shift that is left, all mandatory phrases must stand word for word.
All places where a template stands are returned, scored by the share of template words at their places. Base phrases are found wherever their words stand consecutively.

NULL texts are empty; texts without words or licences have no labels and score 0. Repeated rows are alike; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.llm import common

_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Words of a template whose places are intersected before its phrases are verified.
LOOKED_UP = 4

# Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Sentences, names and tags of public licences, with the phrases that must be there.
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("the MIT License",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "of this software and associated documentation")),
    ("apache-2", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2",)),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License", "version 3")),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License", "version 2")),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU General Public License", "version 3 of the license")),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License", ("GNU General Public License", "version 2 of the license")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    ("agpl-3", "licensed under the GNU Affero General Public License", ("GNU Affero General Public License",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms", "are permitted")),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("CC BY-NC",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("CC BY-SA",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("CC BY-ND",)),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution", "International License")),
    ("cc0", "To the extent possible under law, the author has waived all copyright under CC0", ("has waived all copyright", "CC0")),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("above copyright notice and this permission notice shall be included in all copies",)),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", ("unless required by applicable law or agreed to in writing software distributed under the license", "without warranties or conditions of any kind")),
    ("apache-2", "Apache License 2.0", ("Apache License 2",)),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.", ("provided by the copyright holders and contributors as is and any express or implied warranties", "are disclaimed")),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", ("provided as is without any express or implied warranty", "will the authors be held liable")),
    ("zlib", "zlib License", ("zlib license",)),
    ("boost", "Boost Software License, Version 1.0", ("Boost Software License",)),
    ("epl", "Eclipse Public License, Version 2.0", ("Eclipse Public License",)),
    ("gpl-3", "GNU General Public License v3.0", ("GNU General Public License v3",)),
    ("gpl-2", "GNU General Public License v2.0", ("GNU General Public License v2",)),
    ("gpl-3", "GNU GPL v3", ("GNU GPL v3",)),
    ("gpl-2", "GNU GPL v2", ("GNU GPL v2",)),
    ("gpl-3", "GNU GPLv3", ("GNU GPLv3",)),
    ("gpl-2", "GNU GPLv2", ("GNU GPLv2",)),
    ("mit", "SPDX-License-Identifier: MIT", ("SPDX-License-Identifier: MIT",)),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0", ("SPDX-License-Identifier: Apache-2",)),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0", ("SPDX-License-Identifier: GPL-3",)),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0", ("SPDX-License-Identifier: GPL-2",)),
    ("lgpl", "SPDX-License-Identifier: LGPL", ("SPDX-License-Identifier: LGPL",)),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0", ("SPDX-License-Identifier: AGPL-3",)),
    ("bsd", "SPDX-License-Identifier: BSD", ("SPDX-License-Identifier: BSD",)),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0", ("SPDX-License-Identifier: MPL-2",)),
    ("isc", "SPDX-License-Identifier: ISC", ("SPDX-License-Identifier: ISC",)),
    ("unlicense", "SPDX-License-Identifier: Unlicense", ("SPDX-License-Identifier: Unlicense",)),
    ("zlib", "SPDX-License-Identifier: Zlib", ("SPDX-License-Identifier: Zlib",)),
    ("boost", "SPDX-License-Identifier: BSL-1.0", ("SPDX-License-Identifier: BSL-1",)),
    ("epl", "SPDX-License-Identifier: EPL-2.0", ("SPDX-License-Identifier: EPL",)),
    ("cc0", "SPDX-License-Identifier: CC0-1.0", ("SPDX-License-Identifier: CC0",)),
    ("cc-by", "SPDX-License-Identifier: CC-BY-4.0", ("SPDX-License-Identifier: CC-BY-4",)),
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A to Z in lower case: runs of digits, a to z, and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def places(words: list[bytes], phrase: list[bytes], first: bytes | None = None) -> list[int]:
    """Starts of a phrase in a list of words; ``first``: the word of the phrase to look for (its rarest)."""
    anchor = phrase.index(first) if first else 0
    wanted, found, at = phrase[anchor], [], -1
    while True:
        try:
            at = words.index(wanted, at + 1)
        except ValueError:
            return found
        start = at - anchor
        if start >= 0 and words[start : start + len(phrase)] == phrase:
            found.append(start)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # place in the template, words

    @classmethod
    def of(cls, label: str, text: str, phrases: tuple[str, ...]) -> Template:
        words = words_of(text)
        return cls(label, tuple(words), tuple((places(words, words_of(p))[0], tuple(words_of(p))) for p in phrases))


class Index:
    """Postings of the mandatory words of every template: word to template to places."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], looked_up: int = LOOKED_UP):
        self.templates, self.looked_up = templates, looked_up
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for number, template in enumerate(templates):
            for at, phrase in template.phrases:
                for i, word in enumerate(phrase):
                    self.postings[word][number].append(at + i)
        self.rank = {word: (-idf.get(word, math.inf), word) for word in self.postings}  # rarest first
        self.needed = [{w for _, phrase in t.phrases for w in phrase} for t in templates]
        self.rarest: dict[bytes, list[int]] = defaultdict(list)
        for number, needed in enumerate(self.needed):
            self.rarest[min(needed, key=self.rank.__getitem__)].append(number)

    def candidates(self, words: list[bytes], different: set[bytes]) -> dict[int, set[int]]:
        """Shifts against the text at which the looked-up words of a template are all in place, by template."""
        wanted = {n: self.looked_up for word in self.rarest.keys() & different for n in self.rarest[word] if self.needed[n] <= different}
        shifts: dict[int, set[int]] = {}
        for word in sorted({w for n in wanted for w in self.needed[n]}, key=self.rank.__getitem__):
            holders = [n for n in self.postings[word] if wanted.get(n)]
            found = places(words, [word]) if holders else []
            for n in holders:
                wanted[n] -= 1
                for place in self.postings[word][n]:
                    here = {at - place for at in found}
                    shifts[n] = shifts[n] & here if n in shifts else here
                if not shifts[n]:
                    wanted[n] = 0
        return shifts

    def matches(self, words: list[bytes], different: set[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, start, stop, share of template words in place), best first, of every place where a template stands in the text."""
        best: dict[tuple[str, int, int], float] = {}
        for number, shifts in self.candidates(words, different).items():
            template = self.templates[number]
            for shift in shifts:
                if any(shift + i < 0 or tuple(words[shift + i : shift + i + len(phrase)]) != phrase for i, phrase in template.phrases):
                    continue
                share = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(template.words)) / len(template.words)
                stands = (template.label, max(0, shift), min(len(words), shift + len(template.words)))
                best[stands] = max(share, best.get(stands, 0.0))
        return sorted(((*stands, share) for stands, share in best.items()), key=lambda m: (-m[3], m[0], m[1], m[2]))


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of every template word, counted over all documents; words in none are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        total = 0
        for batch in common.pieces(batches):
            total += batch.num_rows
            for t in batch.column(0).to_pylist():
                seen.update(vocabulary & set(words_of(t)))
        yield pa.record_batch([pa.array([b"", *seen.keys()], pa.binary()), pa.array([total, *seen.values()], pa.int64())], names=["word", "n"])

    common.short_batches(docs.sparkSession)
    counts = {bytes(r["word"]): r["n"] for r in docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.pop(b"", 0)
    return {w: math.log(total / n) for w, n in counts.items() if n}


FOUND = "n_words long, base array<struct<label: string, word: long>>, matches array<struct<label: string, start: long, stop: long, share: double>>"


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """``docs`` without its text, with n_words, base (label and first word of every place) and matches (label, words from start to stop, share)."""
    known = [Template.of(*t) for t in templates]
    phrases = [(words_of(p), label) for p, label in base]
    vocabulary = {w for t in known for w in t.words} | {w for p, _ in phrases for w in p}
    idf = document_frequencies(docs, vocabulary, text)
    kept = [c for c in docs.columns if c != text]
    schema = T.StructType([*[docs.schema[c] for c in kept], *T._parse_datatype_string(FOUND).fields])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(known, idf)
        anchored = [(p, label, max(p, key=lambda w: (idf.get(w, math.inf), w))) for p, label in phrases]
        kinds = (pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])))
        for batch in common.pieces(batches):
            counts, bases, matches = [], [], []
            for t in batch.column(text).to_pylist():
                words = words_of(t)
                different = set(words)
                counts.append(len(words))
                bases.append([{"label": label, "word": at} for p, label, rarest in anchored if rarest in different for at in places(words, p, rarest)])
                matches.append([dict(zip(("label", "start", "stop", "share"), m, strict=True)) for m in index.matches(words, different)])
            yield pa.record_batch([*[batch.column(c) for c in kept], *[pa.array(v, k) for v, k in zip((counts, bases, matches), kinds, strict=True)]], names=schema.names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(find, schema)


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document."""
    found = scan(docs.select("doc_id", "text"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda x: x["label"]), F.transform("matches", lambda x: x["label"]))))
    share = F.array_max(F.transform("matches", lambda x: x["share"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["word"])).alias("first_word"), F.array_max(F.transform("base", lambda x: x["word"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
