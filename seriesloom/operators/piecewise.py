"""Piecewise linear or logistic trend with hinge features (the trend part of Taylor and Letham, 2018).

The hinge weights of a series are a ridge solution, or, with ``penalty="absolute"``, the most probable ones under a Laplace prior: coordinate descent on the absolute-value penalty, which leaves
exact zeros where the series does not bend. Both work on the series' value array, whose length is bounded by the calendar. There is no sampler and no seasonal part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number of changepoints, part of the history they lie in, head room of the logistic cap.
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
CAP_FACTOR = 1.05

_MODEL = T.StructType(
    [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("beta", "knots", "extra", "mu", "sd")]
)


def _hinges(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots[None, :], 0.0)])


def _knots(t: np.ndarray, wanted: int) -> np.ndarray:
    """Evenly spread over the first part of the rows."""
    usable = int(np.floor(len(t) * CHANGEPOINT_RANGE))
    count = max(min(wanted, usable - 1), 0)
    return t[np.linspace(0, max(usable - 1, 0), count + 1).round().astype(int)[1:]] if count else np.empty(0)


def _standardised(columns, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    z = np.array([np.asarray(c, dtype=float) for c in columns]).reshape(len(columns), rows).T
    mu, sd = z.mean(axis=0), z.std(axis=0)
    sd[sd == 0] = 1.0
    return (z - mu) / sd, mu, sd


@F.pandas_udf(_MODEL)
def fit_hinges(ys: pd.Series, changepoints: pd.Series, ridge: pd.Series, extra: pd.Series) -> pd.DataFrame:
    """Ridge fit of hinge features on time scaled to [0, 1], and of standardised extra regressors; level and base slope carry no penalty."""
    out = []
    for y, wanted, penalty, columns in zip(ys, changepoints, ridge, extra):
        y = np.asarray(y, dtype=float)
        t = np.arange(len(y)) / max(len(y) - 1, 1)
        knots = _knots(t, int(wanted))
        z, mu, sd = _standardised(columns, len(y))
        x = np.column_stack([_hinges(t, knots), z])
        weights = np.diag([0.0, 0.0, *[float(penalty)] * (x.shape[1] - 2)])
        beta = np.linalg.lstsq(x.T @ x + weights, x.T @ y, rcond=None)[0]
        split = 2 + len(knots)
        out.append((beta[:split], knots, beta[split:], mu, sd))
    return pd.DataFrame(out, columns=["beta", "knots", "extra", "mu", "sd"])


MOST_SWEEPS = 20_000
SOLVED_EVERY = 25


def sparse_weights(free: np.ndarray, bent: np.ndarray, y: np.ndarray, prior_scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights of ``free`` columns, weights of ``bent`` columns, penalty): least half the squared error plus penalty times the sum of absolute ``bent`` weights.

    The penalty is the noise variance over the prior scale, as of a Laplace prior; the noise is what least squares on all columns leaves. The free columns are projected out
    first, then each bent weight in turn takes its soft threshold. Neighbouring hinges are alike, so sweeps alone settle slowly: now and then the weights that are not zero are solved for together,
    and taken if their signs hold and no other weight wants to move.
    """
    basis = np.linalg.qr(free)[0]
    h, r = bent - basis @ (basis.T @ bent), y - basis @ (basis.T @ y)
    w = np.zeros(bent.shape[1])
    size = max(len(y) - np.linalg.matrix_rank(np.column_stack([free, bent])), 1)
    rest = r - h @ np.linalg.lstsq(h, r, rcond=None)[0] if len(w) else r
    penalty = max(float(rest @ rest) / size / prior_scale, 1e-14 * float(y @ y))
    norms = (h * h).sum(axis=0)
    usable = norms > 1e-12 * max(float((bent * bent).sum(axis=0).max(initial=0.0)), 1e-300)
    cross, pull = h.T @ h, h.T @ r
    for sweep in range(MOST_SWEEPS):
        moved = 0.0
        if sweep % SOLVED_EVERY == SOLVED_EVERY - 1 and w.any():
            at = np.flatnonzero(w)
            solved = np.zeros_like(w)
            solved[at] = np.linalg.lstsq(cross[np.ix_(at, at)], pull[at] - penalty * np.sign(w[at]), rcond=None)[0]
            if (np.sign(solved[at]) == np.sign(w[at])).all() and np.abs(pull - cross @ solved)[usable].max() <= penalty * (1 + 1e-7):
                w = solved
                break
        for j in np.flatnonzero(usable):
            free_pull = pull[j] - cross[j] @ w + norms[j] * w[j]
            new = np.sign(free_pull) * max(abs(free_pull) - penalty, 0.0) / norms[j]
            moved = max(moved, abs(new - w[j]) * np.sqrt(norms[j]))
            w[j] = new
        if moved <= 1e-10 * max(np.sqrt(float(r @ r)), 1e-300):
            break
    return np.linalg.lstsq(free, y - bent @ w, rcond=None)[0], w, penalty


@F.pandas_udf(_MODEL)
def fit_sparse_hinges(ys: pd.Series, changepoints: pd.Series, prior_scale: pd.Series, extra: pd.Series) -> pd.DataFrame:
    """Few bends: values are scaled to a largest size of 1; level, base slope and standardised regressors carry no penalty."""
    out = []
    for y, wanted, scale, columns in zip(ys, changepoints, prior_scale, extra, strict=True):
        y = np.asarray(y, dtype=float)
        size = max(float(np.abs(y).max(initial=0.0)), 1e-300)
        t = np.arange(len(y)) / max(len(y) - 1, 1)
        knots = _knots(t, int(wanted))
        z, mu, sd = _standardised(columns, len(y))
        hinges = _hinges(t, knots)
        free, bent, _ = sparse_weights(np.column_stack([hinges[:, :2], z]), hinges[:, 2:], y / size, float(scale))
        out.append((np.concatenate([free[:2], bent]) * size, knots, free[2:] * size, mu, sd))
    return pd.DataFrame(out, columns=["beta", "knots", "extra", "mu", "sd"])


def trend_at(t: Column) -> Column:
    """Value of the fitted trend at scaled time ``t``."""
    bends = F.zip_with(
        F.slice("m.beta", 3, F.size("m.knots")), "m.knots", lambda b, k: b * F.greatest(t - k, F.lit(0.0))
    )
    return F.get("m.beta", 0) + F.get("m.beta", 1) * t + F.aggregate(bends, F.lit(0.0), lambda s, v: s + v)


def fit_trend(
    series: DataFrame, growth: str = "linear", changepoints: int = CHANGEPOINTS, prior_scale: float = 0.8, regressors: list[str] | None = None, penalty: str = "squared"
) -> DataFrame:
    """Add model struct ``m`` (and ``cap``) to one-row-per-series arrays ``ys``; ``regressors`` name arrays alongside ``ys``.

    ``prior_scale`` plays the usual role: larger lets the trend bend more. ``penalty`` on the bends is "squared" or "absolute". Logistic growth fits
    the log odds of the value below the cap of 1.05 times the maximum.
    """
    if growth not in ("linear", "logistic"):
        raise ValueError("growth must be 'linear' or 'logistic'")
    extra = F.array(*regressors) if regressors else F.array().cast("array<array<double>>")
    series = series.withColumn("cap", F.array_max("ys") * F.lit(CAP_FACTOR))
    target = F.col("ys")
    if growth == "logistic":
        target = F.transform("ys", lambda v: F.log(F.greatest(v, F.lit(1e-9)) / (F.col("cap") - v)))
    fitted = {
        "squared": lambda: fit_hinges(target, F.lit(changepoints), F.lit(1.0 / prior_scale), extra),
        "absolute": lambda: fit_sparse_hinges(target, F.lit(changepoints), F.lit(prior_scale), extra),
    }[penalty]()
    return series.withColumn("m", fitted).withColumn("n_obs", F.size("ys"))


def forecast(model: DataFrame, position: Column, growth: str = "linear", values: list[Column] | None = None) -> Column:
    """Prediction at 0-based ``position`` on the series' own time axis, with the regressors' ``values`` there."""
    raw = trend_at(position / F.greatest(F.col("n_obs") - 1, F.lit(1)))
    for i, v in enumerate(values or []):
        raw = raw + F.get("m.extra", i) * (v - F.get("m.mu", i)) / F.get("m.sd", i)
    return F.col("cap") / (1 + F.exp(-raw)) if growth == "logistic" else raw
