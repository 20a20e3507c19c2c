import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = ""


def sentence(rnd, words, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):03d}x" for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, short, long, repeated and equal texts; null ids, languages and sources; a shared passage; near copies."""
    rnd = random.Random(5)
    passage = sentence(rnd, 60)
    base = sentence(rnd, 120)
    rows = [
        (0, None, "en", "a", None),
        (1, "", "en", None, 0),
        (2, " \t\n", None, "a", 3),
        (3, "one two", "en", "a", 7),
        (4, "ONE Two", "en", "a", 7),
        (5, "!!! ??? ...", None, "b", 11),
        (None, "a text without an id " + passage, "en", "b", None),
        (7, base, "en", "b", None),
        (7, base, "en", "b", None),
        (8, base, "fr", "c", None),
        (9, base.replace(base.split()[50], "changed", 1), "fr", "c", None),
        (10, " ".join(["same"] * 300), "de", "c", None),
        (11, "x" * 5000, "de", "c", None),
        (12, "éàü " * 200 + passage, "fr", "c", None),
        (13, sentence(rnd, 40) + " " + passage + " " + sentence(rnd, 40), "en", "b", None),
        (14, sentence(rnd, 30) + " " + passage, "en", "b", None),
        (15, sentence(rnd, 20000, 3000), "en", "b", None),
        (-3, sentence(rnd, 25), "en", "b", None),
        (2**62, sentence(rnd, 25), "en", "b", None),
    ]
    words = base.split()
    for i in range(12):  # near copies at several distances
        copy = list(words)
        for k in range(1 + i % 4):
            copy[(17 * i + 29 * k) % len(copy)] = f"edit{i}{k}"
        rows.append((100 + i, " ".join(copy), "en", "d", None))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
