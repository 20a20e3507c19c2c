import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import simplex as sx
from seriesloom.operators import smoothing as sm

SEASON = 4


def plain(model, y, w):
    """Squared error by a loop over time."""
    y = [float(v) for v in y]
    if model == "THETA":
        level, total = y[0], 0.0
        for v in y:
            total, level = total + (v - level) ** 2, level + w[0] * (v - level)
        return total
    if model == "HOLT":
        level, trend, total = y[0], (y[1] - y[0] if len(y) > 1 else 0.0), 0.0
        for v in y[1:]:
            ahead = level + w[2] * trend
            new = w[0] * v + (1 - w[0]) * ahead
            level, trend, total = new, w[1] * (new - level) + (1 - w[1]) * w[2] * trend, total + (v - ahead) ** 2
        return total
    level = sum(y[:SEASON]) / SEASON
    trend, offsets, total = (sum(y[SEASON : 2 * SEASON]) / SEASON - level) / SEASON, [v - level for v in y[:SEASON]], 0.0
    for i, v in enumerate(y):
        off, base = offsets[i % SEASON], level + trend
        new = w[0] * (v - off) + (1 - w[0]) * base
        trend = w[1] * (new - level) + (1 - w[1]) * trend
        offsets[i % SEASON] = w[2] * (v - new) + (1 - w[2]) * off
        level, total = new, total + (v - base - off) ** 2
    return total


def made(rnd, n):
    return 50 + np.cumsum(rnd.normal(0.3, 1, n)) + 4 * np.sin(np.arange(n) * np.pi / 2) + rnd.normal(0, 1, n)


@pytest.mark.parametrize("model", sx.MODELS)
def test_errors_and_search(model):
    rnd = np.random.default_rng(4)
    series = [made(rnd, n) for n in (8, 9, 30, 61, 30, 12)] + [np.full(20, 3.0), np.arange(16.0)]
    weights, errors = sx.weights_of(series, model, SEASON)
    low, high = sx._bounds(model)
    assert ((weights >= low) & (weights <= high)).all()
    for y, w, error in zip(series, weights, errors):
        assert error == pytest.approx(plain(model, y, w), rel=1e-9, abs=1e-9)
        assert error <= min(plain(model, y, g) for g in sx._grid(model)) + 1e-9
        fine = [np.clip(w + d, low, high) for d in rnd.normal(0, 0.01, (60, len(w)))]
        assert error <= min(plain(model, y, p) for p in fine) * (1 + 1e-3) + 1e-9  # no better point next to it
    alone = [sx.weights_of([y], model, SEASON)[1][0] for y in series]
    assert np.allclose(errors, alone, rtol=1e-9)  # the others of a batch do not matter


def test_the_search_finds_known_minima():
    """Bowls with their lowest point inside and outside the bounds."""
    at = np.array([[0.3, 0.7], [0.9, 0.1], [1.4, 0.5], [0.2, -3.0]])
    low, high = np.zeros(2), np.ones(2)
    found, _ = sx.search(lambda rows, p: ((p - at[rows][:, None]) ** 2 * [1, 5]).sum(axis=2), np.full((4, 2), 0.5), low, high)
    assert np.allclose(found, np.clip(at, 0, 1), atol=1e-3)


@pytest.mark.parametrize("model", ["HOLT", "ETS"])
def test_rows_and_odd_series(spark, model):
    rnd = np.random.default_rng(5)
    rows = [(f"s{i}", [float(v) for v in made(rnd, 40)]) for i in range(5)]
    rows += [("none", None), ("null", [1.0, None] * 10), ("one", [1.0]), ("empty", []), ("inf", [1.0, float("inf")] * 6)]
    df = spark.createDataFrame(rows, "k string, ys array<double>")
    fits = {r.k: r for r in sx.with_best_weights(df, model, SEASON).collect()}
    assert len(fits) == 10 and all(fits[k].alpha == sm.LEVEL_GRID[0] for k in ("none", "null", "empty", "inf"))
    state = sm.holt if model == "HOLT" else lambda s: sm.holt_winters(s, SEASON)
    usable = df.where(F.col("k").startswith("s"))
    grid = sm.with_grid(usable, sm.param_rows(damped=model == "HOLT", seasonal=model == "ETS"))
    least = {r.k: r.sse for r in sm.best_params(state(grid).select("k", *sx.NAMES, "sse"), "k").collect()}
    found = {r.k: r.sse for r in state(sx.with_best_weights(usable, model, SEASON)).collect()}
    assert set(found) == set(least) and all(found[k] <= least[k] * (1 + 1e-12) for k in found)
    assert sx.with_best_weights(df.where("false"), model, SEASON).collect() == []
