import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import mixing


def test_raking_meets_all_targets(spark):
    rnd = random.Random(1)
    cells = [(s, la, t, rnd.randrange(5, 500)) for s in "abcdef" for la in ("en", "fr") for t in ("x", "y", "z") if rnd.random() < 0.8]
    targets = {"source": {s: 1.0 + i for i, s in enumerate("abcdef")}, "lang": {"en": 2.0, "fr": 3.0, "none": 5.0}, "topic": {"x": 0.2, "y": 0.5, "z": 0.3}}
    wanted = {m: {k: v / sum(w for c, w in t.items() if c != "none") for k, v in t.items() if k != "none"} for m, t in targets.items()}
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    frames = {m: spark.createDataFrame([(k, v) for k, v in t.items()], f"{m} string, target double") for m, t in targets.items()}
    frames["source"] = spark.createDataFrame(list(wanted["source"].items()), "source string, target double")
    got = mixing.raked(df, frames).toPandas()
    share = got["share"] / got["share"].sum()
    for m, t in wanted.items():
        sums = share.groupby(got[m]).sum()
        assert sums.to_dict() == pytest.approx(t, rel=1e-4)
    table = {(s, la, t): n for s, la, t, n in cells}  # plain raking of the same table
    w = dict(table)
    for _ in range(400):
        for k, m in enumerate(("source", "lang", "topic")):
            now = {c: sum(v for key, v in w.items() if key[k] == c) for c in wanted[m]}
            w = {key: v * wanted[m][key[k]] / now[key[k]] for key, v in w.items()}
    mine = {(r.source, r.lang, r.topic): float(s) for r, s in zip(got.itertuples(), share, strict=True)}
    assert mine == pytest.approx(w, rel=1e-3)


def test_scale_reaches_the_budget(spark):
    df = spark.createDataFrame([(100, 0.1), (1000, 0.2), (10, 0.7)], "tokens long, share double")
    s = mixing.scaled(df, 500.0)
    assert sum(min(t, s * w) for t, w in [(100, 0.1), (1000, 0.2), (10, 0.7)]) == pytest.approx(500, rel=1e-6)
    assert mixing.scaled(df, 1110) == float("inf")


def test_odd_rows(odd_docs, odd_rows):
    docs = odd_docs.withColumn("share", F.lit(1)).withColumn("tokens", F.lit(2)).withColumn("topic", F.lit("clash"))
    rows = mixing.mixed(docs).toPandas()
    assert len(rows) == len(odd_rows)
    assert rows["_probability"].between(0, 1).all()
    empty = rows["_tokens"] == 0
    assert empty.sum() == 3 and not rows.loc[empty, "_kept"].any()
    total = rows["_tokens"].sum()
    assert (rows["_tokens"] * rows["_probability"]).sum() == pytest.approx(mixing.KEPT_TOKENS * total, rel=1e-3)
    twice = rows[rows["doc_id"] == 7]
    assert len(twice) == 2 and twice["_kept"].nunique() == 1
    assert mixing.sampled(docs).columns == docs.columns


def test_tokens_and_topics(spark):
    texts = [None, "", "  a  b\tc\n", "| a | b | c |", "LOUD WORDS", "*** a &&&", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.tokens_of(F.col("text")).alias("n"), mixing.topic_of(F.col("text")).alias("t"))
    assert [tuple(r) for r in df.collect()] == [(0, "notes"), (0, "notes"), (3, "notes"), (7, "tables"), (2, "shouting"), (3, "marked"), (1, "prose")]


def test_draws_are_uniform(spark):
    values = spark.range(4000).select(mixing.draw(F.col("id"), F.lit("t")).alias("u")).toPandas()["u"]
    assert abs(values.mean() - 0.5) < 0.02 and np.histogram(values, 10, (0, 1))[0].min() > 320


def test_empty_table(no_docs):
    assert mixing.summary(no_docs).collect() == []


def test_counts_on_bytes_equal_columns(spark, odd_rows):
    rnd = random.Random(3)
    texts = [r[1] for r in odd_rows] + ["".join(rnd.choice("ab |*#AB\u00e9\u65e5\n\t\x0b\x1f\u00a0") for _ in range(rnd.randrange(0, 600))) for _ in range(200)]
    texts += ["| a " * 40, "*$%" * 9 + "abc" * 20, "ABC abc " * 60, None, "", " ", "a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    want = {r.i: (r.n, r.t) for r in df.select("i", mixing.tokens_of(F.col("text")).alias("n"), mixing.topic_of(F.col("text")).alias("t")).collect()}
    got = {r.row.i: (r.tokens, r.topic) for r in mixing.with_features(df, "text", ["i"]).collect()}
    assert got == want


def test_user_columns_of_any_name(odd_docs):
    names = ["_rate", "_kept", "_tokens", "rate", "tokens", "topic", "row", "kept", "share", "drawn", "probability"]
    docs = odd_docs.withColumns({c: F.lit(f"mine {c}") for c in names})
    out = mixing.sampled(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"mine {c}" for r in rows for c in names)
    once = mixing.sampled(odd_docs).toPandas()
    assert sorted(map(str, once["doc_id"])) == sorted(str(r.doc_id) if r.doc_id is not None else "nan" for r in rows) or len(once) == len(rows)


def test_joins_rake_like_the_driver(spark, monkeypatch):
    rnd = random.Random(7)
    cells = spark.createDataFrame([(s, la, t, rnd.randrange(5, 90)) for s in "abcd" for la in ("en", "fr") for t in ("x", "y", "z")], "source string, lang string, topic string, tokens long")
    targets = {m: mixing.own_targets(cells, m, p) for m, p in mixing.POWERS.items()}
    one = {r[:3]: r[4] for r in map(tuple, mixing.raked(cells, targets).collect())}
    monkeypatch.setattr(mixing, "MOST_COMBINATIONS", 2)
    found = mixing.raked(cells, targets)
    two = {r[:3]: r[4] for r in map(tuple, found.collect())}
    assert mixing.margin_gap(found, targets) < 1e-4
    total = sum(one.values())
    assert {k: v / total for k, v in one.items()} == pytest.approx(two, rel=1e-3)


def test_targets_out_of_reach_are_reported(spark):
    cells = spark.createDataFrame([("a", "en", "x", 10), ("b", "fr", "y", 10)], "source string, lang string, topic string, tokens long")
    targets = {m: spark.createDataFrame([(k, 0.2), (v, 0.8)] if m != "lang" else [(k, 0.7), (v, 0.3)], f"{m} string, target double") for m, (k, v) in {"source": "ab", "lang": ("en", "fr"), "topic": "xy"}.items()}
    assert mixing.margin_gap(mixing.raked(cells, targets), targets) > 0.1
