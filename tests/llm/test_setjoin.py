import random

import pytest
from brute import near_documents, shingle_set
from pyspark.sql import functions as F

from seriesloom.llm import setjoin


def result(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.query_rows(docs).collect()), key=str)


def test_odd_rows(odd_docs, odd_rows):
    assert result(odd_docs) == sorted(near_documents([(r[0], r[1]) for r in odd_rows]), key=str)


def test_chains_of_near_copies(spark):
    """Neighbours link, the ends of a chain do not; every text starts with the same frequent passage."""
    rnd = random.Random(3)
    frequent = " ".join(f"f{i}" for i in range(12))
    rows, key = [], 0
    for _ in range(6):
        words = [f"v{rnd.randrange(300)}" for _ in range(70)]
        for step in range(12):
            rows.append((key, f"{frequent} " + " ".join(words)))
            key += 1
            words[(step * 11) % 70] = f"n{key}"
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == sorted(near_documents(rows), key=str)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(words[: 30 - i])) for i in range(12)]  # sets of 26 to 15 shingles, nested
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == sorted(near_documents(rows), key=str)


def test_one_of_each(odd_docs, odd_rows):
    kept = setjoin.one_of_each(odd_docs.withColumn("root", F.lit(1)).withColumn("_copy", F.lit(2)))
    assert kept.columns == [*odd_docs.columns, "root", "_copy"]
    rows = kept.collect()
    classes = near_documents([(r[0], r[1]) for r in odd_rows])
    with_words = {c for (_, n, c) in classes if n}
    assert sum(1 for r in rows if shingle_set(r.text)) == len(with_words)
    assert {r.doc_id for r in rows if shingle_set(r.text) and r.doc_id is not None} == {c for c in with_words if c is not None}
    assert sum(1 for r in rows if not shingle_set(r.text)) == sum(1 for r in odd_rows if not shingle_set(r[1]))


def test_empty_table(no_docs):
    assert result(no_docs) == []
    assert setjoin.one_of_each(no_docs).collect() == []


@pytest.mark.parametrize("n", [1, 2, 5, 9, 10, 11, 600])
def test_prefix_length(n):
    assert setjoin.prefix_length(n) == n - -(-4 * n // 5) + 1 == n + 80 * -n // 100 + 1


def test_bitmaps_bound_the_difference():
    import numpy as np

    rnd = np.random.default_rng(1)
    for n in (3, 500, 520, 3000, 40_000):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n - n // 9], rnd.integers(0, 2**63, n // 5).astype(np.uint64)])
        x, y = setjoin.bitmap(a), setjoin.bitmap(b)
        size = min(len(x), len(y))
        differ = int(np.bitwise_count(setjoin._folded([x], size) ^ setjoin._folded([y], size)).sum())
        true = len(np.setxor1d(a, b))
        assert differ <= true and (n > 16_000 or differ >= 0.6 * true)
