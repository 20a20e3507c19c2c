import random
import re

from pyspark.sql import functions as F

from seriesloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Some words. Released under the MIT License. More words",
    "UNDER-THE mit\nlicense under the MIT license",
    "Licensed under the Apache License, Version 2.0.",
    "apache license version 2 and CC BY-NC 4.0; cc by nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
    "general version 3 of the public gnu license",  # the words, not in place
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "éunder the mit license",
    None,
    "",
    "...",
    "word " * 3000 + "under the mit license",
]


def brute(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    found = sorted((i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, TEXTS[0]])), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    rows = {r.doc_id: r for r in licenses.summary(docs).collect()}
    assert len(rows) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_method_adds_labels(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(100 + i, f"plain text number {i}") for i in range(60)], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licenses.summary(docs).collect()}
    assert labels[4] == "gpl-3" and labels[5] == "gpl-2" and labels[6] == "" and labels[7] == "mit"
    assert all(labels[100 + i] == "" for i in range(60))


def test_spans(spark):
    docs = spark.createDataFrame([(1, "x y " + TEXTS[4] + " z")], "doc_id long, text string")
    match = licenses.scan(docs).first().matches[0]
    assert (match.label, match.start, match.stop, match.share) == ("gpl-3", 2, 14, 1.0)


STATEMENTS = [text for _, text, _ in licenses.TEMPLATES]


def plain_matches(text):
    """Every template at every shift."""
    words, found = licenses.words_of(text), {}
    for t in (licenses.Template.of(*t) for t in licenses.TEMPLATES):
        for shift in range(-len(t.words), len(words)):
            if all(shift + at >= 0 and tuple(words[shift + at : shift + at + len(p)]) == p for at, p in t.phrases):
                share = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(t.words)) / len(t.words)
                key = (t.label, max(0, shift), min(len(words), shift + len(t.words)))
                found[key] = max(share, found.get(key, 0))
    return sorted((*k, v) for k, v in found.items())


def test_several_licences_under_skewed_frequencies(spark):
    """Two to five statements in a text, also cut or repeated; all words of one, then of another template are rare."""
    rnd = random.Random(3)
    texts = [f"{STATEMENTS[9]}. It is {STATEMENTS[7]}."]
    texts += [" and ".join(s if rnd.random() < 0.7 else s.rsplit(" ", 1)[0] for s in rnd.choices(STATEMENTS, k=rnd.randrange(2, 6))) for _ in range(40)]
    frequent = [" ".join(s.split()[::-1]) for i, s in enumerate(STATEMENTS) if i not in (9, 11, 12)]
    docs = spark.createDataFrame(list(enumerate(texts + frequent * 30)), "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).where(F.col("doc_id") < len(texts)).collect()}
    assert {m.label for m in rows[0].matches} == {"bsd", "lgpl"}
    for i, text in enumerate(texts):
        assert sorted(map(tuple, rows[i].matches)) == plain_matches(text)
    known = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    vocabulary = sorted({w for t in known for w in t.words})
    for _ in range(20):
        index = licenses.Index(known, {w: rnd.expovariate(1) for w in vocabulary})
        for text in texts:
            words = licenses.words_of(text)
            assert sorted(index.matches(words, set(words))) == plain_matches(text)


def test_names_tags_and_bodies(spark):
    wanted = {
        "released as GNU GPL v3 code": "gpl-3",
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2",
        "/* SPDX-License-Identifier: BSD-3-Clause */": "bsd",
        "SPDX-License-Identifier: CC-BY-4.0": "cc-by",
        "the GNU General Public License v3.0.": "gpl-3",
        "Apache License 2.0": "apache-2",
        "Distributed under the Boost Software License, Version 1.0.": "boost",
        "the Eclipse Public License": "epl",
        "this is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable": "zlib",
        "x" * 50 + " " + STATEMENTS[18] + " " + STATEMENTS[21]: "bsd,mit",
        "license identifier spdx mit; general gnu v3 license public": "",
        "provided as is. The authors will be held liable without any express or implied warranty": "",
    }
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.summary(docs).collect()}
    assert [rows[i].labels for i in range(len(wanted))] == list(wanted.values())


def test_the_number_of_looked_up_words_changes_no_result():
    """Any number finds what every template at every shift finds; more words leave fewer shifts to verify."""
    rnd = random.Random(8)
    known = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    vocabulary = sorted({w for t in known for w in t.words})
    filler = [w.decode() for w in vocabulary]
    for _ in range(15):
        parts = rnd.choices(STATEMENTS, k=3) + [" ".join(rnd.choices(filler, k=60)) for _ in range(4)]
        rnd.shuffle(parts)
        words = licenses.words_of(" ".join(parts))
        idf, left = {w: rnd.expovariate(1) for w in vocabulary}, []
        for looked_up in (1, 2, 4, 100):
            index = licenses.Index(known, idf, looked_up)
            assert sorted(index.matches(words, set(words))) == plain_matches(" ".join(parts))
            left.append(sum(map(len, index.candidates(words, set(words)).values())))
        assert left == sorted(left, reverse=True)


def test_empty_table(no_docs):
    assert licenses.summary(no_docs).collect() == []
