import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import piecewise as pw


def columns(n, count=25):
    t = np.arange(n) / (n - 1)
    knots = pw._knots(t, count)
    table = pw._hinges(t, knots)
    return t, knots, table[:, :2], table[:, 2:]


@pytest.mark.parametrize("scale", [0.01, 0.1, 0.8])
def test_optimality(scale):
    rnd = np.random.default_rng(int(scale * 100))
    t, _, free, bent = columns(90)
    y = 0.3 + 0.4 * t - 0.6 * np.maximum(t - 0.35, 0) + 0.02 * rnd.normal(size=90)
    base, w, penalty = pw.sparse_weights(free, bent, y, scale)
    rest = y - free @ base - bent @ w
    assert free.T @ rest == pytest.approx(np.zeros(2), abs=1e-9)
    pull = bent.T @ rest
    assert np.abs(pull).max() <= penalty * (1 + 1e-5) + 1e-9
    for j in np.flatnonzero(w):
        assert pull[j] == pytest.approx(np.sign(w[j]) * penalty, rel=1e-4, abs=1e-8)
    assert 0 < (w != 0).sum() < 15


def test_straight_series_have_no_bend(spark):
    rows = [("straight", [5.0 + 2 * i for i in range(60)]), ("bent", [10.0 + 3 * min(i, 24) for i in range(60)]), ("flat", [4.0] * 60), ("short", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "member string, ys array<double>")
    model = pw.fit_trend(df, penalty="absolute")
    got = {r.member: r for r in model.select("member", "m", pw.forecast(model, F.lit(30.0)).alias("at_30")).collect()}
    for m in ("straight", "flat", "short"):
        assert all(v == 0 for v in got[m].m.beta[2:])
    assert got["straight"].at_30 == pytest.approx(65.0) and got["flat"].at_30 == pytest.approx(4.0)
    assert got["bent"].at_30 == pytest.approx(82.0, abs=0.5)


def test_regressors_are_free(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=80)
    y = 20 + 0.1 * np.arange(80) + 3 * x
    df = spark.createDataFrame([("a", y.tolist(), x.tolist())], "member string, ys array<double>, x array<double>")
    model = pw.fit_trend(df, regressors=["x"], penalty="absolute")
    r = model.select(pw.forecast(model, F.lit(90.0), "linear", [F.lit(1.0)]).alias("p"), "m").first()
    assert r.p == pytest.approx(20 + 9 + 3, rel=1e-6) and all(v == 0 for v in r.m.beta[2:])
