import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from seriesloom.functions import time as tm
from seriesloom.operators import boosting as bo
from seriesloom.operators import trees as te


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(900):
        a, b, c = rnd.uniform(-2, 2), float(rnd.randrange(5)), rnd.gauss(0, 1)
        rows.append((a if i % 17 else None, b, c, 3 * (a > 0.3) + b * b / 4 + (2 if b > 2 and a < 0 else 0) + rnd.gauss(0, 0.2), i % 4 == 0))
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w boolean"), rows


def plain_rounds(x, y, depth, rounds, step, penalty, least):
    """Boosted trees grown over all midpoints of sorted values, as functions."""
    base = y.mean()
    predicted = np.full(len(y), base)
    trees = []

    def gain(g):
        return g.sum() ** 2 / (len(g) + penalty)

    def grow(rows, level):
        g = predicted[rows] - y[rows]
        best = (1e-9, None, None)
        if level < depth:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= cut
                    if left.sum() >= least and (~left).sum() >= least:
                        won = gain(g[left]) + gain(g[~left]) - gain(g)
                        if won > best[0] + 1e-7:
                            best = (won, f, cut)
        if best[1] is None:
            value = -step * g.sum() / (len(g) + penalty) if level else 0.0
            return lambda z: np.full(len(z), value)
        left = x[rows, best[1]] <= best[2]
        one, two = grow(rows[left], level + 1), grow(rows[~left], level + 1)
        return lambda z, f=best[1], c=best[2]: np.where(z[:, f] <= c, one(z), two(z))

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        predicted = predicted + tree(x)
    return lambda z: base + sum(t(z) for t in trees)


@pytest.mark.parametrize(("depth", "penalty", "least"), [(1, 1.0, 1), (2, 0.5, 20), (3, 0.0, 5)])
def test_equals_plain_trees(spark, depth, penalty, least):
    rnd = random.Random(depth)
    rows = [(float(rnd.randrange(9)), float(rnd.randrange(7)), rnd.gauss(0, 1)) for _ in range(400)]
    rows = [(a, b, n + a * (b > 3)) for a, b, n in rows]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    model = bo.fit(df, ["a", "b"], "y", [bo.Setting(5, depth, 0.3, least_rows=least, leaf_penalty=penalty)])[0]
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows])
    want = plain_rounds(x, y, depth, 5, 0.3, penalty, least)(x)
    got = bo.scored(df, model).toPandas()
    assert np.allclose(model.predict(x), want)
    assert sorted(got["predicted"]) == pytest.approx(sorted(want))


def test_watched_rows_choose_the_trees(table):
    df, rows = table
    models = bo.fit(df, ["a", "b", "c"], "y", [bo.Setting(400, 2, 0.1, 0.8, 0.8, 5), bo.Setting(30, 1, 0.1)], "w", patience=20)
    for model in models:
        assert len(model.roots) == int(np.argmin(model.errors)) + 1
        held = np.array([r[:3] for r in rows if r[4]], float)
        y = np.array([r[3] for r in rows if r[4]])
        assert np.mean((model.predict(held) - y) ** 2) == pytest.approx(min(model.errors))
        assert min(model.errors) <= model.errors[0]
    assert len(models[0].roots) > 50 and len(models[0].errors) <= 400


def test_few_cells_merge_bins(table):
    df, rows = table
    fine, coarse = (bo.fit(df, ["a", "b", "c"], "y", [bo.Setting(60, 2, 0.2)], most_cells=m)[0] for m in (10_000, 60))
    x, y = np.array([r[:3] for r in rows], float), np.array([r[3] for r in rows])
    assert np.mean((fine.predict(x) - y) ** 2) < np.mean((coarse.predict(x) - y) ** 2) < np.var(y)
    assert len(np.unique(coarse.threshold[coarse.feature == 0])) < len(np.unique(fine.threshold[fine.feature == 0]))


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        bo.fit(spark.createDataFrame([], "a double, y double"), ["a"], "y", [bo.Setting(2, 1, 0.1)])


def test_recursion_equals_steps(spark):
    rnd = random.Random(2)
    series = {m: [50 + 10 * k + 5 * np.sin(i / 2) + rnd.random() for i in range(60)] for k, m in enumerate("ABC")}
    lagged = [(v[i - 1], v[i - 3], tm_sin(i), v[i]) for v in series.values() for i in range(3, 60)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in lagged], "l1 double, l3 double, s double, y double")
    model = bo.fit(df, ["l1", "s", "l3"], "y", [bo.Setting(80, 2, 0.1)])[0]
    state = spark.createDataFrame([(m, [float(x) for x in v[-3:]], dt.date(2004, 12, 1)) for m, v in series.items()], "m string, ys array<double>, at date")
    got = {(r.m, r.h): r.predicted for r in bo.recursive_forecast(model, state, {"l1": 1, "l3": 3}, {"s": tm.month_sin}, 132, lambda at, h: F.add_months(at, h)).collect()}
    assert len(got) == 3 * 132
    for m, v in series.items():
        past = list(v)
        for h in range(1, 133):
            past.append(float(model.predict(np.array([[past[-1], np.sin(2 * np.pi * ((h - 1) % 12 + 1) / 12), past[-3]]]))[0]))
            assert got[m, h] == pytest.approx(past[-1])


def tm_sin(i):
    return float(np.sin(2 * np.pi * (i % 12 + 1) / 12))


def test_declared_settings_keep_many_trees(spark):
    rows = entry.queries()["boosted_tree_scores"](spark, "/root/testdata/sf0.01").collect()
    assert {r.params for r in rows} == {f"depth={s.depth}" for s in te.BOOSTED_GRID}
    assert all(r.n_trees > 50 for r in rows)
