import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import common, langid, quality, toxicity
from seriesloom.llm.common import table

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables absent")


def remainder(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def area(scores, y):
    """Share of (1, 0) pairs in the right order."""
    order = np.asarray(scores)
    one, zero = order[y == 1], order[y == 0]
    return ((one[:, None] > zero[None]).mean() + (one[:, None] == zero[None]).mean() / 2).item()


def test_split_is_crc32_of_the_id(spark):
    rows = spark.range(50).select("id", common.remainder(F.col("id"), 5).alias("r")).collect()
    assert all(r.r == remainder(r.id, 5) for r in rows)


@needs_tables
def test_languages_held_out(spark):
    docs = table(spark, SF, "documents")
    rows = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    assert (rows["held_out"] == [remainder(k, 4) == 2 for k in rows["doc_id"]]).all()
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and rows["score"].between(0, 1).all()


@needs_tables
def test_held_out_labels_change_nothing(spark):
    """Labels of the held-out part, and lang and source, may be anything."""
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    lies = labels.withColumns({c: F.when(common.remainder(F.col("doc_id"), 5) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    for classify in (quality.classify, toxicity.classify):
        one = classify(docs, labels).orderBy("doc_id").collect()
        assert one == classify(other, lies).orderBy("doc_id").collect()


@needs_tables
@pytest.mark.parametrize(("classify", "mark", "least"), [(quality.classify, "quality", 0.97), (toxicity.classify, "toxic", 0.7)])
def test_labels_held_out(spark, classify, mark, least):
    labels = table(spark, SF, "labels")
    rows = classify(table(spark, SF, "documents"), labels).toPandas()
    assert len(rows) == 1000 and rows["score"].between(0, 1).all()
    cut = 0.3 if mark == "quality" else 0.5
    assert (rows["predicted"] == (rows["score"] >= cut)).all()
    held = rows[rows["held_out"]].merge(labels.toPandas())
    assert area(held["score"], held[mark].to_numpy()) > least


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd_docs, odd_rows):
    marks = [(r[0], i % 2, (i + 1) % 2) for i, r in enumerate(odd_rows)] + [(0, None, None), (1, 7, -1), (None, 1, 1), (3, 0, 1), (3, 1, 1)]
    docs = odd_docs.withColumn("score", F.lit("clash")).withColumn("y", F.lit(1)).withColumn("_id", F.lit(1))
    for classify in (quality.classify, toxicity.classify):
        rows = classify(docs, _labels(spark, marks)).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in odd_rows)
        assert all(0 <= r.score <= 1 for r in rows)
        twice = [r.score for r in rows if r.doc_id == 7]
        assert len(set(twice)) == 1
    rows = langid.identify(docs).collect()
    letterless = {0, 1, 2, 5}
    assert all((r.lang_pred == "und" and r.score == 0) == (r.doc_id in letterless) for r in rows)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "de", "und"}


def test_without_labels(spark, odd_docs, no_docs):
    none = _labels(spark, [])
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert {r.predicted for r in toxicity.classify(odd_docs, none).collect()} == {0}
    assert {r.predicted for r in toxicity.classify(odd_docs, _labels(spark, [(k, 1, 0) for k in range(20)])).collect()} == {0}
    for classify in (quality.classify, toxicity.classify):
        assert classify(no_docs, none).collect() == []
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(no_docs).collect() == []


@pytest.mark.parametrize("share", [0.05, 0.35, 0.6])
def test_toxic_shares(spark, share):
    """Held-out toxic rows are found at every share of the mark, and few others."""
    rnd = np.random.default_rng(11)
    names = ["".join(rnd.choice(list("abcdefghijklmnop"), 7)) for _ in range(312)]
    bad, plain = names[:12], names[12:]
    rows = []
    for i in range(2000):
        toxic = int(rnd.random() < share)
        words = list(rnd.choice(plain, 25)) + [w for w in bad if rnd.random() < (0.3 if toxic else 0.005)]
        rows.append((i, " ".join(map(str, rnd.permutation(words))), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = toxicity.classify(docs, _labels(spark, [(i, 0, y) for i, _, y in rows])).where("held_out").toPandas()
    truth = np.array([rows[i][2] for i in got["doc_id"]])
    found = got["predicted"].to_numpy()
    assert found[truth == 1].mean() > 0.85 and found[truth == 0].mean() < 0.15


def test_trigrams_and_bundles():
    assert len(langid.trigrams(None)) == len(langid.trigrams(" 12 .")) == 0
    assert langid.trigrams("Ab, c").tolist() == langid.trigrams("ab c").tolist() == [0 * 4096 + 1 * 64 + 2, 1 * 4096 + 2 * 64, 3 * 64]
    vectors = langid.Trigrams(64)
    letters = vectors.placed[2]
    one = np.roll(letters[1], 2) * np.roll(letters[2], 1) * letters[3]
    assert vectors.bundle(np.array([1 * 4096 + 2 * 64 + 3]), np.array([2])).tolist() == (2 * one.astype(float)).tolist()


def test_dual_descent_reaches_the_optimum():
    """The hinge-loss objective is no higher than at nearby weights."""
    rnd = np.random.default_rng(2)
    rows = [np.unique(rnd.integers(0, 30, 8)).astype(np.int32) for _ in range(60)]
    y = np.array([int(g.min() < 4) for g in rows])
    ratio = quality.count_ratios(rows, y)
    weight, bias = quality.dual_descent(rows, y, ratio, epochs=400)
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))

    def objective(w, b):
        scaled = [ratio[g] / max(np.linalg.norm(ratio[g]), 1e-9) for g in rows]
        margins = np.array([w[g] @ s + b for g, s in zip(rows, scaled, strict=True)])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - (2 * y - 1) * margins)).sum()

    best = objective(weight, bias)
    for _ in range(30):
        step = np.zeros_like(weight)
        step[:30] = rnd.normal(0, 0.05, 30)
        assert objective(weight + step, bias + rnd.normal(0, 0.05)) > best - 1e-3


def test_label_model_finds_rates():
    rnd = np.random.default_rng(5)
    truth = rnd.random(4000) < 0.2
    strong, weak = np.where(truth, rnd.random(4000) < 0.9, rnd.random(4000) < 0.05), rnd.random(4000) < 0.3
    mark = np.where(rnd.random(4000) < 0.95, truth, ~truth)
    votes = np.stack([strong, strong, weak, 2 * mark.astype(int) - 1], axis=1).astype(np.int8)
    model = toxicity.label_model(votes)
    assert model.rates[1, 0, 2] > 0.75 and model.rates[0, 0, 2] < 0.12 and abs(model.rates[1, 2, 2] - model.rates[0, 2, 2]) < 0.08
    assert model.share[0] < 0.6 < model.share[2]  # two voters that repeat each other count about once
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.94
