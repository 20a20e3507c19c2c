import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import backtest as bt
from seriesloom.operators import fill


def dense_spline(x, y, at):
    """The same spline from truncated powers and one dense solve: a parabola and a bend of the second derivative at every inner middle."""
    bends = (x[1:-2] + x[2:-1]) / 2 if len(x) > 3 else np.empty(0)

    def table(t):
        return np.column_stack([np.ones(len(t)), t, t * t, *(np.maximum(t - b, 0) ** 2 for b in bends)])

    return table(at) @ np.linalg.solve(table(x), y)


@pytest.mark.parametrize("n", [3, 4, 5, 9, 24])
def test_band_equals_dense(n):
    rnd = np.random.default_rng(n)
    x = np.sort(rnd.choice(np.arange(n * 3), n, replace=False)).astype(float)
    y = rnd.normal(size=n) * 10
    at = np.linspace(x[0], x[-1], 200)
    want = dense_spline((x - x[0]) / 10, y, (at - x[0]) / 10)
    assert fill.spline_values(x, y, at) == pytest.approx(want, rel=1e-6 if n > 20 else 1e-9, abs=1e-6 if n > 20 else 1e-9)
    assert fill.spline_values(x, y, x) == pytest.approx(y, abs=1e-9)


def test_second_derivative_is_constant_between_knots_and_the_first_one_continuous():
    rnd = np.random.default_rng(1)
    x, y = np.arange(0.0, 40.0, 4), rnd.normal(size=10)
    h = 1e-3
    edges = np.unique(fill.spline_knots(x))
    for a, b in zip(edges, edges[1:], strict=False):
        at = np.linspace(a + 3 * h, b - 3 * h, 7)
        bend = (fill.spline_values(x, y, at + h) - 2 * fill.spline_values(x, y, at) + fill.spline_values(x, y, at - h)) / h**2
        assert bend == pytest.approx(np.full(7, bend[0]), abs=1e-4)
    for k in edges[1:-1]:
        ends = [(fill.spline_values(x, y, np.array([k + s * h]))[0] - fill.spline_values(x, y, np.array([k]))[0]) / (s * h) for s in (-1, 1)]
        assert ends[0] == pytest.approx(ends[1], abs=0.02)


def test_gaps_of_series(spark):
    rows = [("a", i, float(i * i) if i in (1, 4, 6, 9) else None) for i in range(12)] + [("b", 0, 5.0), ("b", 1, None), ("c", 0, 1.0), ("c", 1, None), ("c", 2, 3.0), ("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in fill.interpolate_spline(df, "k", "t", "v").collect()}
    assert len(got) == len(rows)
    assert [got["a", i] for i in range(1, 10)] == pytest.approx([float(i * i) for i in range(1, 10)])
    assert got["a", 0] is None and got["a", 11] is None
    assert got["b", 1] is None and got["c", 1] == pytest.approx(2.0) and got["d", 0] is None


def test_updates_equal_refits(spark):
    rnd = random.Random(3)
    rows = []
    for k, m in enumerate("ab"):
        for i in range(70):
            x = [1e6 + 1000 * rnd.random() + 3 * i, rnd.gauss(0, 1e-3), float(i)]
            rows.append((m, i, 5 + 0.01 * x[0] - 900 * x[1] + k * i + rnd.random(), *x))
    rows[10] = ("a", 10, None, *rows[10][3:])
    rows[20] = (*rows[20][:3], None, *rows[20][4:])
    df = spark.createDataFrame(rows, "m string, t int, y double, p double, q double, r double").repartition(3)
    got = {(r.m, r.t): r.predicted for r in bt.driver_line(["p", "q", "r"])(df, "m", "t", "y").collect()}
    for m in "ab":
        own = [r for r in rows if r[0] == m]
        for t in range(70):
            past = [r for r in own[:t] if None not in r]
            if None in own[t][3:] or len(past) <= 4:
                assert got[m, t] is None
                continue
            x, y = np.array([r[3:] for r in past]), np.array([r[2] for r in past])
            middle, width = x.mean(axis=0), x.std(axis=0)
            z = np.column_stack([np.ones(len(x)), (x - middle) / width])
            b = np.linalg.lstsq(z, y, rcond=None)[0]
            assert got[m, t] == pytest.approx(float(np.array([1, *((np.array(own[t][3:]) - middle) / width)]) @ b), rel=1e-7)


def test_constant_driver_gives_no_forecast(spark):
    df = spark.createDataFrame([("a", i, float(i), 1.0) for i in range(9)], "m string, t int, y double, x double")
    assert bt.driver_line(["x"])(df, "m", "t", "y").where(F.col("predicted").isNotNull()).count() == 0
