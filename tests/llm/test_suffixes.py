import random

import numpy as np
import pytest
from brute import repeated_bytes
from pyspark.sql import functions as F

from seriesloom.llm import suffixes


def check(docs, rows, length=200):
    got = sorted(((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.summary(docs, length).collect()))
    assert got == sorted(repeated_bytes([r[1] for r in rows], length))


def test_odd_rows(odd_docs, odd_rows):
    check(odd_docs, odd_rows)


def test_short_length_over_few_letters(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(400)))) for i in range(60)] + [(90, "ab" * 300), (91, "a" * 300)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, 40)


def _edges(spark):
    rnd = random.Random(8)
    passage = "".join(rnd.choice("abcdefgh é") for _ in range(420))
    rows = []
    for i in range(50):
        a, b = rnd.randrange(0, 150), rnd.randrange(250, 421)
        head = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 300)))
        tail = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 300)))
        rows.append((i, head + passage[a:b] + tail))
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_passages_cut_at_many_places(spark):
    rows, docs = _edges(spark)
    check(docs, rows)


def test_crowded_tokens_are_sliced(spark, monkeypatch):
    rows, docs = _edges(spark)
    texts = docs.select(suffixes.text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    spans = {}
    for most in (3, 50_000):
        found, _ = suffixes.repeated_spans(texts, 200, most)
        covered = {}
        for r in found.collect():
            covered.setdefault(r.text_key, set()).update(range(r.start, r.stop))
        spans[most] = covered
    assert spans[3] == spans[50_000]


def test_no_group_of_a_crowded_token_is_sorted_whole(spark, monkeypatch):
    """A passage between different surroundings: no more than ``most`` contexts of one token meet, and the spans stay exact."""
    rnd = random.Random(12)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(230))
    rows = [(i, "".join(rnd.choice("abc") for _ in range(300)) + passage + "".join(rnd.choice("abc") for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    largest, sort, spans = [], suffixes.sorted_buckets, suffixes.repeated_spans

    def watched(contexts, length):
        group = [c for c in ("token", "block", "shared") if c in contexts.columns]
        largest.append(max([r["count"] for r in contexts.groupBy(*group).count().collect()], default=0))
        return sort(contexts, length)

    monkeypatch.setattr(suffixes, "sorted_buckets", watched)
    monkeypatch.setattr(suffixes, "repeated_spans", lambda texts, length: spans(texts, length, 3))
    check(docs, rows)
    assert largest and max(largest) <= 3


@pytest.mark.parametrize("hot", [3, 10_000])
def test_counted_strings(spark, hot):
    rows = [(1, 0, 5, 6, i, 10 * i, i == 0) for i in range(9)] + [(1, 1, 5, 6, 20, 7, False), (2, 0, 5, 7, 21, 8, False), (2, 0, 5, 7, 22, 9, False)]
    strings = spark.createDataFrame(rows, "token long, offset int, high long, low long, text_key long, start long, whole boolean")
    got = {tuple(r) for r in suffixes.counted_strings(strings, 200, hot).collect()}
    assert got == {(i, 10 * i, 10 * i + 200) for i in range(1, 9)} | {(21, 8, 208), (22, 9, 209)}


def test_copies_have_one_lead(spark, monkeypatch):
    """Tokens of a copied text are crowded however its key falls, and each of its contexts is read once."""
    rnd = random.Random(9)
    bases = ["".join(rnd.choice("abcdefgh ") for _ in range(600)) for _ in range(4)]
    texts = spark.createDataFrame(enumerate(bases), "n long, text string").crossJoin(spark.range(2000)).select(suffixes.text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    found = suffixes.found_anchors(texts, 200).where("stop IS NULL").drop("stop").localCheckpoint()
    crowded = suffixes.crowded_tokens(found)
    assert crowded.count() == found.select("token").distinct().count()
    monkeypatch.setattr(suffixes, "crowded_tokens", lambda _: crowded)
    rows = [(i, bases[0]) for i in range(40)] + [(50, bases[0][:400] + "x" + bases[0][401:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(suffixes.text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    hits = suffixes.meeting_anchors(suffixes.found_anchors(keyed, 200).where("stop IS NULL").drop("stop").localCheckpoint())
    assert {r["count"] for r in hits.where("lead").groupBy("token", "context").count().collect()} == {1}
    assert {r.copies for r in hits.collect()} <= {1, 40, 41}
    check(docs, rows)


def test_segments_of_long_texts(spark, monkeypatch):
    rnd = random.Random(4)
    data = np.frombuffer(bytes(rnd.choice(b"abcdef") for _ in range(5000)), np.uint8)
    whole = suffixes.anchors(data)
    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    cut = suffixes.anchors(data)
    assert whole[1].sum() == cut[1].sum() == len(data) - 199
    assert set(whole[2].tolist()) == set(cut[2].tolist())


def test_without_repeats_keeps_columns(odd_docs):
    left = suffixes.without_repeats(odd_docs.withColumn("kept", F.lit(1)))
    assert left.columns == [*odd_docs.columns, "kept"] and left.count() == odd_docs.count()
    assert left.where("doc_id = 1").first().text == "" and left.where("doc_id = 0").first().text is None


@pytest.mark.parametrize("width", [1, 2, 7, 40])
def test_least_positions(width):
    values = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    plain = [p + int(np.argmin(values[p : p + width])) for p in range(len(values) - width + 1)]
    assert suffixes.least_positions(values, width).tolist() == plain


def test_multikey_order():
    rnd = np.random.default_rng(6)
    keys = [rnd.integers(0, 4, 500) for _ in range(4)]
    order, tied = suffixes.multikey_order(keys)
    rows = list(zip(*(k[order].tolist() for k in keys), strict=True))
    assert rows == sorted(rows)
    assert tied.tolist() == [False, *(a == b for a, b in zip(rows, rows[1:], strict=False))]


def test_empty_table(no_docs):
    assert suffixes.summary(no_docs).collect() == []
    assert suffixes.without_repeats(no_docs).collect() == []
