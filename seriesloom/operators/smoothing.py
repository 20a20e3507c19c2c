"""Exponential smoothing and seasonal-naive forecasts as folds over the ordered values of a series.

A monthly series has at most one value per calendar month, so the collected array is bounded by
the calendar. Candidate parameters come from an exploded literal grid; the (series, parameter)
pairs are independent rows that Spark spreads over its tasks.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.keys import as_list, literal_rows
from seriesloom.session import spread

# Search grid for the smoothing weights (level, trend) and the damping.
LEVEL_GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
TREND_GRID = (0.05, 0.1, 0.3, 0.5)
DAMPING_GRID = (0.8, 0.9, 0.98)
SEASON_GRID = (0.05, 0.2, 0.4)
THETA_GRID = tuple(a / 20 for a in range(1, 20))

_PARAM_TYPES = {"alpha": "double", "beta": "double", "phi": "double", "gamma": "double"}


def param_rows(damped: bool = False, seasonal: bool = False) -> list[dict]:
    phis = DAMPING_GRID if damped else (1.0,)
    gammas = SEASON_GRID if seasonal else (0.0,)
    return [
        {"alpha": a, "beta": b, "phi": p, "gamma": g}
        for a, b, p, g in product(LEVEL_GRID, TREND_GRID, phis, gammas)
    ]


def as_arrays(df: DataFrame, key: str | list[str], ts: str, value: str, rows: Column | None = None) -> DataFrame:
    """One row per series with its values in time order."""
    if rows is not None:
        df = df.where(rows)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).alias("y"))))
    return df.groupBy(*as_list(key)).agg(pairs.alias("_p")).select(
        *as_list(key), F.transform("_p", lambda p: p["y"]).alias("ys"), F.transform("_p", lambda p: p["t"]).alias("tss")
    )


def with_grid(series: DataFrame, rows: list[dict]) -> DataFrame:
    """Every series with every parameter row; the pairs are spread over all tasks."""
    keys = [c for c in series.columns if c not in ("ys", "tss")]
    pairs = series.select("*", F.inline(literal_rows(rows, _PARAM_TYPES)))
    return spread(pairs, *keys, *_PARAM_TYPES) if len(rows) > 1 else pairs


def _holt_step(alpha, beta, phi):
    def step(s, y):
        ahead = s["l"] + phi * s["b"]
        level = alpha * y + (1 - alpha) * ahead
        trend = beta * (level - s["l"]) + (1 - beta) * phi * s["b"]
        err = y - ahead
        return F.struct(
            level.alias("l"), trend.alias("b"), (s["sse"] + err * err).alias("sse"), F.concat(s["f"], F.array(ahead)).alias("f")
        )

    return step


def _holt_step_light(alpha, beta, phi):
    def step(s, y):
        ahead = s["l"] + phi * s["b"]
        level = alpha * y + (1 - alpha) * ahead
        trend = beta * (level - s["l"]) + (1 - beta) * phi * s["b"]
        err = y - ahead
        return F.struct(level.alias("l"), trend.alias("b"), (s["sse"] + err * err).alias("sse"))

    return step


def holt(series: DataFrame, fitted: bool = False) -> DataFrame:
    """Additive (damped when phi < 1) trend smoothing of ``ys`` with the row's alpha, beta, phi.

    The start is level y1 and trend y2-y1. Adds level ``l``, trend ``b``, squared error ``sse``
    of the one-step forecasts from the second value on, and with ``fitted`` those forecasts ``f``
    (the first value stands for itself).
    """
    alpha, beta, phi = F.col("alpha"), F.col("beta"), F.col("phi")
    y1, y2 = F.get("ys", 0).cast("double"), F.get("ys", 1).cast("double")
    start = [y1.alias("l"), F.coalesce(y2 - y1, F.lit(0.0)).alias("b"), F.lit(0.0).alias("sse")]
    tail = F.slice("ys", 2, F.greatest(F.size("ys") - 1, F.lit(0)))
    if fitted:
        state = F.aggregate(tail, F.struct(*start, F.array(y1).alias("f")), _holt_step(alpha, beta, phi))
    else:
        state = F.aggregate(tail, F.struct(*start), _holt_step_light(alpha, beta, phi))
    return series.withColumn("_s", state).select("*", "_s.*").drop("_s")


def damped_sum(phi: Column, h: Column) -> Column:
    """phi + phi^2 + ... + phi^h."""
    return F.when(phi == 1, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))


def holt_forecast(state: DataFrame, h: Column) -> Column:
    return F.col("l") + damped_sum(F.col("phi"), h) * F.col("b")


def best_params(fits: DataFrame, key: str | list[str]) -> DataFrame:
    """Row with the least squared error per series; equal errors fall to the smaller parameters."""
    rest = [c for c in fits.columns if c not in as_list(key)]
    order = F.struct("sse", "alpha", "beta", "phi", "gamma")
    return fits.groupBy(*as_list(key)).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*as_list(key), "_r.*")


def holt_winters(series: DataFrame, season: int = 12) -> DataFrame:
    """Additive trend and season smoothing with the row's alpha, beta, gamma.

    Starts from the first two seasons: level and trend from their means, seasonal offsets from
    the first season. Adds ``l``, ``b``, the last season's offsets ``seas`` (next step first),
    one-step forecasts ``f`` and ``sse``.
    """
    alpha, beta, gamma = F.col("alpha"), F.col("beta"), F.col("gamma")
    m = F.lit(season)

    def mean(arr):
        return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v) / m

    first, second = mean(F.slice("ys", 1, season)), mean(F.slice("ys", season + 1, season))
    start = F.struct(
        first.alias("l"),
        ((second - first) / m).alias("b"),
        F.transform(F.slice("ys", 1, season), lambda v: v - first).alias("seas"),
        F.lit(0.0).alias("sse"),
        F.array().cast("array<double>").alias("f"),
    )

    def step(s, y):
        off = F.get(s["seas"], 0)
        base = s["l"] + s["b"]
        err = y - (base + off)
        level = alpha * (y - off) + (1 - alpha) * base
        trend = beta * (level - s["l"]) + (1 - beta) * s["b"]
        return F.struct(
            level.alias("l"),
            trend.alias("b"),
            F.concat(F.slice(s["seas"], 2, season - 1), F.array(gamma * (y - level) + (1 - gamma) * off)).alias("seas"),
            (s["sse"] + err * err).alias("sse"),
            F.concat(s["f"], F.array(base + off)).alias("f"),
        )

    long_enough = series.where(F.size("ys") >= 2 * season)
    return long_enough.withColumn("_s", F.aggregate("ys", start, step)).select("*", "_s.*").drop("_s")


def holt_winters_forecast(h: Column, season: int = 12) -> Column:
    return F.col("l") + h * F.col("b") + F.get("seas", ((h - 1) % season).cast("int"))


def seasonal_naive(df: DataFrame, key: str | list[str], y: str, train_end: Column, season: int = 12) -> DataFrame:
    """Forecast of every row after ``train_end`` (a position): the train value one or more whole seasons earlier.

    Needs ``rn``. With less than one season of history it is the last train value. Train rows get
    the value one season back, NULL during the first season.
    """
    key = as_list(key)
    rows = df.withColumn("_te", train_end)
    cycle = F.when(F.col("_te") >= season, F.col("rn") - F.col("_te") - 1 - season * F.floor((F.col("rn") - F.col("_te") - 1) / season))
    source = F.when(F.col("rn") <= F.col("_te"), F.col("rn") - season).when(
        F.col("_te") >= season, F.col("_te") - season + 1 + cycle
    ).otherwise(F.col("_te"))
    history = df.select(*key, F.col("rn").alias("_src"), F.col(y).alias("predicted"))
    return rows.withColumn("_src", source.cast("int")).join(history, [*key, "_src"], "left").drop("_src", "_te")


def theta(series: DataFrame, season: int = 12) -> DataFrame:
    """Two-line theta state per series and smoothing weight: level of the smoothed line and half the
    straight-line slope as drift (Assimakopoulos and Nikolopoulos, 2000)."""
    n = F.size("ys").cast("double")
    idx = F.transform("ys", lambda v, i: F.struct(i.cast("double").alias("i"), v.alias("v")))
    sums = F.aggregate(
        idx,
        F.struct(F.lit(0.0).alias("sy"), F.lit(0.0).alias("sxy")),
        lambda s, p: F.struct((s["sy"] + p["v"]).alias("sy"), (s["sxy"] + p["i"] * p["v"]).alias("sxy")),
    )
    sx, sxx = n * (n - 1) / 2, (n - 1) * n * (2 * n - 1) / 6
    slope = (n * F.col("_m.sxy") - sx * F.col("_m.sy")) / F.nullif(n * sxx - sx * sx, F.lit(0.0))
    alpha = F.col("alpha")

    def step(s, y):
        err = y - s["l"]
        return F.struct((s["l"] + alpha * err).alias("l"), (s["sse"] + err * err).alias("sse"))

    smooth = F.aggregate("ys", F.struct(F.get("ys", 0).alias("l"), F.lit(0.0).alias("sse")), step)
    return (
        series.withColumn("_m", sums)
        .withColumns({"b": slope, "_s": smooth, "n_obs": n})
        .select("*", "_s.*")
        .drop("_m", "_s")
    )


def theta_forecast(h: Column) -> Column:
    a = F.col("alpha")
    return F.col("l") + F.col("b") / 2 * (h - 1 + 1 / a - F.pow(1 - a, F.col("n_obs")) / a)
