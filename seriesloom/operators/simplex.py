"""Smoothing weights by a simplex search (Nelder and Mead, 1965) from the best point of the grid.

Series are independent rows; a task takes an Arrow batch of them and searches for all series of a part together: each
time step of the recursion is one numpy operation over all series and trial points. The result is never worse than the grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import smoothing as sm
from seriesloom.session import spread

NAMES = ("alpha", "beta", "phi", "gamma")
# Bounds of the weights; the damping keeps to the span of its grid.
LOWEST, HIGHEST = 1e-4, 1 - 1e-4
SERIES_AT_ONCE = 128
MOST_STEPS = 200
TOLERANCE = 1e-10

MODELS = {"HOLT": ("alpha", "beta", "phi"), "ETS": ("alpha", "beta", "gamma"), "THETA": ("alpha",)}


def _grid(model: str) -> np.ndarray:
    if model == "THETA":
        return np.array([[a] for a in sm.THETA_GRID])
    rows = sm.param_rows(damped=model == "HOLT", seasonal=model == "ETS")
    return np.array([[r[n] for n in MODELS[model]] for r in rows])


def _bounds(model: str) -> tuple[np.ndarray, np.ndarray]:
    damping = (min(sm.DAMPING_GRID), max(sm.DAMPING_GRID))
    both = [damping if n == "phi" else (LOWEST, HIGHEST) for n in MODELS[model]]
    return tuple(np.array(side) for side in zip(*both, strict=True))


def holt_errors(y: np.ndarray, n: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared one-step errors of damped trend smoothing: ``y`` series by time, ``points`` series by trials by (alpha, beta, phi)."""
    a, b, phi = np.moveaxis(points, 2, 0)
    level = np.broadcast_to(y[:, :1], a.shape).copy()
    trend = np.where(n > 1, y[:, min(1, y.shape[1] - 1)] - y[:, 0], 0.0)[:, None] * np.ones_like(a)
    total = np.zeros_like(a)
    for t in range(1, y.shape[1]):
        on = (t < n)[:, None]
        ahead = level + phi * trend
        err = y[:, t, None] - ahead
        new = a * y[:, t, None] + (1 - a) * ahead
        trend = np.where(on, b * (new - level) + (1 - b) * phi * trend, trend)
        level = np.where(on, new, level)
        total += np.where(on, err * err, 0.0)
    return total


def seasonal_errors(y: np.ndarray, n: np.ndarray, points: np.ndarray, season: int) -> np.ndarray:
    """The same for additive trend and season with (alpha, beta, gamma); every series has two seasons."""
    a, b, g = np.moveaxis(points, 2, 0)
    first, second = y[:, :season].mean(axis=1), y[:, season : 2 * season].mean(axis=1)
    level = first[:, None] * np.ones_like(a)
    trend = ((second - first) / season)[:, None] * np.ones_like(a)
    offsets = (y[:, :season] - first[:, None])[:, None, :] * np.ones((*a.shape, 1))
    total = np.zeros_like(a)
    for t in range(y.shape[1]):
        on, off = (t < n)[:, None], offsets[:, :, t % season]
        base = level + trend
        err = y[:, t, None] - (base + off)
        new = a * (y[:, t, None] - off) + (1 - a) * base
        trend = np.where(on, b * (new - level) + (1 - b) * trend, trend)
        offsets[:, :, t % season] = np.where(on, g * (y[:, t, None] - new) + (1 - g) * off, off)
        level = np.where(on, new, level)
        total += np.where(on, err * err, 0.0)
    return total


def level_errors(y: np.ndarray, n: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same for the smoothed line of the theta method with (alpha,)."""
    a = points[:, :, 0]
    level, total = np.broadcast_to(y[:, :1], a.shape).copy(), np.zeros_like(a)
    for t in range(y.shape[1]):
        err = np.where((t < n)[:, None], y[:, t, None] - level, 0.0)
        level, total = level + a * err, total + err * err
    return total


def search(errors, start: np.ndarray, low: np.ndarray, high: np.ndarray, most_steps: int = MOST_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Least error from ``start`` (series by weights) within the bounds, all series together; ``errors(rows, points)`` judges trials of some series."""
    count, k = start.shape
    step = np.where(start + 0.05 <= high, 0.05, -0.05) * np.minimum(1.0, (high - low) / 0.2)
    points = start[:, None, :] + np.concatenate([np.zeros((1, k)), np.eye(k)])[None] * step[:, None, :]
    points = np.clip(points, low, high)
    worth = errors(np.arange(count), points)
    going = np.arange(count)
    for _ in range(most_steps):
        p, f = points[going], worth[going]
        order = np.argsort(f, axis=1, kind="stable")
        p, f = np.take_along_axis(p, order[:, :, None], 1), np.take_along_axis(f, order, 1)
        points[going], worth[going] = p, f
        on = (f[:, -1] - f[:, 0] > TOLERANCE * np.abs(f[:, 0])) & (np.abs(p - p[:, :1]).max(axis=(1, 2)) > 1e-7)
        going, p, f = going[on], p[on], f[on]
        if not len(going):
            break
        centre, worst = p[:, :-1].mean(axis=1), p[:, -1]
        trials = np.clip(np.stack([centre + c * (centre - worst) for c in (1.0, 2.0, 0.5, -0.5)], axis=1), low, high)
        mirrored, beyond, outside, inside = np.moveaxis(errors(going, trials), 1, 0)
        take = np.full(len(going), -1)
        take[(mirrored < f[:, 0])] = 0
        take[(mirrored < f[:, 0]) & (beyond < mirrored)] = 1
        take[(mirrored >= f[:, 0]) & (mirrored < f[:, -2])] = 0
        near = mirrored >= f[:, -2] if k > 1 else mirrored >= f[:, 0]
        take[near & (mirrored < f[:, -1]) & (outside <= mirrored)] = 2
        take[near & (mirrored >= f[:, -1]) & (inside < f[:, -1])] = 3
        moved = take >= 0
        rows = np.flatnonzero(moved)
        points[going[rows], -1] = trials[rows, take[rows]]
        worth[going[rows], -1] = np.stack([mirrored, beyond, outside, inside], axis=1)[rows, take[rows]]
        rows = np.flatnonzero(~moved)
        if len(rows):
            shrunk = p[rows, :1] + 0.5 * (p[rows] - p[rows, :1])
            points[going[rows]] = shrunk
            worth[going[rows], 1:] = errors(going[rows], shrunk[:, 1:])
    best = np.argmin(worth, axis=1)
    rows = np.arange(count)
    return points[rows, best], worth[rows, best]


def weights_of(series: list[np.ndarray], model: str, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squared error of each series (one value or more, finite; two seasons for a seasonal model)."""
    n = np.array([len(v) for v in series])
    y = np.stack([np.pad(v, (0, n.max() - len(v)), mode="edge") for v in series])
    judge = {"HOLT": holt_errors, "ETS": partial(seasonal_errors, season=season), "THETA": level_errors}[model]

    def errors(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            found = judge(y[rows], n[rows], points)
        return np.where(np.isfinite(found), found, np.inf)

    grid = _grid(model)
    on_grid = errors(np.arange(len(series)), np.broadcast_to(grid, (len(series), *grid.shape)))
    best = np.argmin(on_grid, axis=1)  # the first of equal ones has the smaller weights
    start, least = grid[best], on_grid[np.arange(len(series)), best]
    low, high = _bounds(model)
    found, error = search(errors, start, low, high)
    better = error < least
    return np.where(better[:, None], found, start), np.where(better, error, least)


def with_best_weights(series: DataFrame, model: str, season: int = 12) -> DataFrame:
    """Every row of ``series`` (with its values ``ys``) with the weights alpha, beta, phi, gamma that fit it best.

    ``model`` is HOLT (damped trend), ETS (trend and season) or THETA (level); weights it lacks are 0, its damping 1. Series that hold a NULL or
    a non-finite value, or are too short to judge, get the first weights of the grid.
    """
    names, used = series.columns, MODELS[model]
    need = 2 * season if model == "ETS" else 1
    first = _grid(model)[0]
    schema = T.StructType([*series.schema.fields, *[T.StructField(c, T.DoubleType()) for c in NAMES]])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SERIES_AT_ONCE):
                part = batch.iloc[at : at + SERIES_AT_ONCE].reset_index(drop=True)
                values = [np.array([np.nan] if v is None else v, dtype=float) for v in part["ys"]]
                usable = [i for i, v in enumerate(values) if len(v) >= need and np.isfinite(v).all()]
                weights = np.tile(first, (len(part), 1))
                if usable:
                    weights[usable] = weights_of([values[i] for i in usable], model, season)[0]
                held = dict(zip(used, weights.T, strict=True))
                for c in NAMES:
                    part[c] = held.get(c, 1.0 if c == "phi" else 0.0)
                yield part[[*names, *NAMES]]

    keys = [c for c in names if c not in ("ys", "tss")]
    return spread(series, *[F.col(k) for k in keys]).mapInPandas(fit, schema)
