"""Walk-forward back-test: every fold is forecast by models that saw only earlier rows of its series.

An evaluator maps (df, key, ts, value) to the same rows plus ``predicted``. The built-in ones refit for every
fold through running sums or a single fold over the series, so T folds cost T rows per
series instead of T training sets.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators import arima as ar
from seriesloom.operators import smoothing as sm
from seriesloom.operators.keys import as_list, series_window
from seriesloom.operators.metrics import residuals
from seriesloom.operators.trend import expanding_line
from seriesloom.session import spread

Evaluator = Callable[[DataFrame, "str | list[str]", str, str], DataFrame]


def expanding(df: DataFrame, key: str | list[str], ts: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the training rows of every fold, that is all earlier rows of the series.

    Running aggregates stand in for a join of each fold with its earlier rows, which would emit T*T/2 rows.
    """
    past = series_window(key, ts).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: c.over(past) for name, c in aggs.items()})


def naive(df: DataFrame, key, ts: str, value: str) -> DataFrame:
    return df.withColumn("predicted", F.lag(value).over(series_window(key, ts)))


def seasonal(season: int) -> Evaluator:
    """Value one season earlier, or the previous one while the history is shorter than a season."""

    def run(df: DataFrame, key, ts: str, value: str) -> DataFrame:
        w = series_window(key, ts)
        return df.withColumn("predicted", F.coalesce(F.lag(value, season).over(w), F.lag(value).over(w)))

    return run


def _numbered(df: DataFrame, key, ts: str) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(series_window(key, ts)))


def line(df: DataFrame, key, ts: str, value: str) -> DataFrame:
    return expanding_line(_numbered(df, key, ts), key, "_i", value).drop("_i")


def lag_line(df: DataFrame, key, ts: str, value: str) -> DataFrame:
    """Regression on the previous value, refitted for every fold on all earlier pairs by running sums.

    Values are taken from the series' first one, so that the sums stay small.
    """
    w = series_window(key, ts)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    base = df.withColumn("_y", F.col(value) - F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    base = base.withColumn("_x", F.lag("_y").over(w))
    x, y = F.col("_x"), F.when(F.col("_x").isNotNull(), F.col("_y"))
    base = base.withColumns({"_n": F.count(y).over(past).cast("double"), "_sx": F.sum(x).over(past), "_sy": F.sum(y).over(past), "_sxx": F.sum(x * x).over(past), "_sxy": F.sum(x * y).over(past)})
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    slope = (n * F.col("_sxy") - sx * sy) / F.nullif(n * F.col("_sxx") - sx * sx, F.lit(0.0))
    ahead = (sy - slope * sx) / F.nullif(n, F.lit(0.0)) + slope * x + (F.col(value) - F.col("_y"))
    return base.withColumn("predicted", ahead).drop("_y", "_x", "_n", "_sx", "_sy", "_sxx", "_sxy")


def refits_by_updates(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One-step forecasts of a least-squares regression with a constant, refitted on all earlier rows before each one; NaN until the earlier rows determine it.

    After the first fit every row changes the inverse cross-product by one rank (Sherman and Morrison), so a fold costs the square of the number of drivers. Rows with a missing value
    neither get a forecast nor change the fit.
    """
    out = np.full(len(y), np.nan)
    known = np.isfinite(x).all(axis=1) & np.isfinite(y)
    usable = np.isfinite(x).all(axis=1)
    size = x.shape[1] + 1
    first = np.flatnonzero(known)[: size + 1]
    if len(first) <= size:
        return out
    middle, spread_ = x[first].mean(axis=0), x[first].std(axis=0)
    z = np.column_stack([np.ones(len(y)), (x - middle) / np.where(spread_ > 0, spread_, 1.0)])
    level = y[first].mean()
    inverse, beta, seen = None, None, 0
    for t in range(len(y)):
        if beta is not None and usable[t]:
            out[t] = z[t] @ beta + level
        if not known[t]:
            continue
        seen += 1
        if beta is None:
            if seen > size:
                rows = np.flatnonzero(known[: t + 1])
                cross = z[rows].T @ z[rows]
                if np.linalg.matrix_rank(z[rows]) == size:
                    inverse = np.linalg.inv(cross)
                    beta = inverse @ (z[rows].T @ (y[rows] - level))
        else:
            gain = inverse @ z[t] / (1.0 + z[t] @ inverse @ z[t])
            beta = beta + gain * (y[t] - level - z[t] @ beta)
            inverse = inverse - np.outer(gain, z[t] @ inverse)
    return out


def driver_line(drivers: list[str]) -> Evaluator:
    """Regression on drivers of the same row, refitted for every fold; a series, bounded by the calendar, is one row of arrays in one pass."""

    def run(df: DataFrame, key, ts: str, value: str) -> DataFrame:
        keys = as_list(key)
        item = F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("y"), F.array(*(F.col(d).cast("double") for d in drivers)).alias("x"))
        packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
        ready = packed.select(*keys, F.col("_rows.t").alias("_t"), F.col("_rows.y").alias("_y"), F.col("_rows.x").alias("_x"))

        @F.pandas_udf("array<double>")
        def ahead(ys: pd.Series, xs: pd.Series) -> pd.Series:
            return pd.Series([refits_by_updates(np.array([[np.nan if v is None else v for v in row] for row in x], dtype=float), np.array(y, dtype=float)) for y, x in zip(ys, xs, strict=True)])

        made = ready.select(*keys, F.inline(F.arrays_zip(F.col("_t").alias("t"), ahead("_y", "_x").alias("p")))).toDF(*keys, ts, "_p")
        return df.join(made, [*keys, ts], "left").withColumn("predicted", F.when(~F.isnan("_p"), F.col("_p"))).drop("_p")

    return run


def arima_refit(grid: ar.Grid, min_train: int) -> Evaluator:
    """One order refitted for every fold on its earlier rows: the folds of a series are dealt to tasks, each fits its prefix of the array."""

    def run(df: DataFrame, key, ts: str, value: str) -> DataFrame:
        keys = as_list(key)
        item = F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("y"))
        packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows")).where(F.size("_rows") > min_train)
        dealt = packed.select(*keys, F.transform("_rows", lambda r: r["y"]).alias("_ys"), F.posexplode(F.transform("_rows", lambda r: r["t"])).alias("_at", ts)).where(F.col("_at") >= min_train)
        fold = ar.one_step(grid)(F.slice("_ys", F.lit(1), F.col("_at")))
        return df.join(spread(dealt, *keys, ts).select(*keys, ts, fold.alias("predicted")), [*keys, ts], "left")

    return run


def holt_refit(grid: list[dict]) -> Evaluator:
    """Trend smoothing whose parameters are chosen anew for every fold by the squared error so far.

    Smoothing the whole series once per parameter set yields the one-step forecast of every fold;
    the running error before the fold ranks the sets.
    """

    def run(df: DataFrame, key, ts: str, value: str) -> DataFrame:
        key = as_list(key)
        fits = sm.holt(sm.with_grid(sm.as_arrays(df, key, ts, value), grid), fitted=True)
        steps = F.arrays_zip(F.col("tss").alias("t"), F.col("ys").alias("y"), F.col("f").alias("f"))
        rows = fits.select(*key, "alpha", "beta", "phi", "gamma", F.inline(steps)).toDF(
            *key, "alpha", "beta", "phi", "gamma", ts, "_y", "_f"
        )
        w = series_window([*key, "alpha", "beta", "phi", "gamma"], ts)
        err = (F.col("_y") - F.col("_f")) * (F.col("_y") - F.col("_f"))
        rows = rows.withColumn("_sse", F.sum(err).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        best = rows.groupBy(*key, ts).agg(
            F.min_by("_f", F.struct("_sse", "alpha", "beta", "phi", "gamma")).alias("predicted")
        )
        return df.join(best, [*key, ts], "left")

    return run


DEFAULT_EVALUATORS: dict[str, Evaluator] = {
    "NAIVE": naive,
    "TREND": line,
    "REGRESSION": lag_line,
    "HOLT": holt_refit(sm.param_rows(damped=True)),
    "ARIMA": arima_refit(ar.Grid(), 10),
}


def walk_forward(
    df: DataFrame,
    key: str | list[str],
    ts: str,
    value: str,
    evaluators: dict[str, Evaluator],
    min_train: int = 10,
    fold_label: Column | None = None,
) -> DataFrame:
    """One row per (series, fold, pipeline): actual, predicted and errors, for every fold with at
    least ``min_train`` earlier rows."""
    key = as_list(key)
    label = fold_label if fold_label is not None else F.col(ts)
    numbered = df.withColumn("_pos", F.row_number().over(series_window(key, ts)))
    parts = []
    for name, run in evaluators.items():
        scored = run(numbered, key, ts, value).where(F.col("_pos") > min_train)
        parts.append(
            scored.select(*key, label.alias("fold"), F.lit(name).alias("pipeline"), F.col(value).alias("actual"), "predicted")
        )
    return residuals(reduce(lambda a, b: a.unionByName(b), parts))
