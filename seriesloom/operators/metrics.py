"""Forecast error measures as aggregate expressions over (actual, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.operators.keys import as_list, series_window

_INF = float("inf")


def rmse(a: Column, p: Column) -> Column:
    return F.sqrt(F.avg((a - p) * (a - p)))


def rmse_guarded(a: Column, p: Column) -> Column:
    """Infinity when any error is not finite or has exploded, so that such a candidate sorts last."""
    err = a - p
    usable = nm.is_finite(err) & (F.abs(err) <= F.lit(nm.EXPLODED_ERROR))
    bad = F.count(F.when(err.isNotNull() & ~usable, 1)) > 0
    safe = F.when(usable, err)
    return F.when(bad, F.lit(_INF)).otherwise(F.sqrt(F.avg(safe * safe)))


def mae(a: Column, p: Column) -> Column:
    return F.avg(F.abs(a - p))


def mape(a: Column, p: Column, zero: str = "skip") -> Column:
    """``skip`` leaves rows with actual 0 out, ``error`` lets the division fail, ``unguarded`` counts them as infinite (no number if the error is 0 too)."""
    if zero == "unguarded":
        at_zero = F.when(p == 0, F.lit(float("nan"))).otherwise(F.lit(_INF))
        return F.avg(F.when(a == 0, at_zero).otherwise(F.abs((a - p) / F.nullif(a, F.lit(0.0))))) * 100
    base = F.nullif(a, F.lit(0.0)) if zero == "skip" else a
    return F.avg(F.abs((a - p) / base)) * 100


def r2(a: Column, p: Column) -> Column:
    return 1 - F.sum((a - p) * (a - p)) / F.nullif(F.var_pop(a) * F.count(a), F.lit(0.0))


def mase(mae_value: Column, scale: Column) -> Column:
    return mae_value / F.nullif(scale, F.lit(0.0))


def bundle(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """RMSE, MAE, MAPE and R2 of the scorable rows of each group, in one aggregate."""
    a, p = F.col(actual), F.col(predicted)
    return df.where(nm.is_valid(p) & a.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        rmse_guarded(a, p).alias("rmse"),
        mae(a, p).alias("mae"),
        mape(a, p).alias("mape"),
        r2(a, p).alias("r2"),
    )


def naive_scale(df: DataFrame, key: str | list[str], ts: str, value: str, season: int = 1) -> DataFrame:
    """Mean absolute seasonal difference per series: the scale of MASE. NULL for short or constant series."""
    diff = F.abs(F.col(value) - F.lag(value, season).over(series_window(key, ts)))
    scale = F.avg("_d")
    return (
        df.withColumn("_d", diff)
        .groupBy(*as_list(key))
        .agg(F.when(scale > 0, scale).alias("scale"))
    )


def with_mase(metrics: DataFrame, scales: DataFrame, key: str | list[str]) -> DataFrame:
    return (
        metrics.join(scales, as_list(key), "left")
        .withColumn("mase", mase(F.col("mae"), F.col("scale")))
        .drop("scale")
    )


def split_bundle(preds: DataFrame, by: list[str]) -> DataFrame:
    """Train, validation and test RMSE/MAE/MAPE side by side, in one pass and one shuffle."""
    p, a = F.col("predicted"), F.col("actual")
    aggs = []
    for split in ("TRAIN", "VAL", "TEST"):
        here = (F.col("split") == split) & nm.is_valid(p) & a.isNotNull()
        act, pred = F.when(here, a), F.when(here, p)
        name = split.lower()
        aggs += [
            rmse_guarded(act, pred).alias(f"{name}_rmse"),
            mae(act, pred).alias(f"{name}_mae"),
            mape(act, pred).alias(f"{name}_mape"),
        ]
    return preds.groupBy(*by).agg(*aggs)


def residuals(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Error, absolute error and absolute percentage error of each row."""
    a, p = F.col(actual), F.col(predicted)
    return df.withColumns(
        {
            "error": p - a,
            "abs_error": F.abs(p - a),
            "ape": F.abs(p - a) / F.nullif(a, F.lit(0.0)) * 100,
        }
    )


def pivot_splits(metrics: DataFrame, by: list[str], value: str) -> DataFrame:
    """Long (model, split) metrics to one row per model; the split list is fixed, so no extra job finds it."""
    return metrics.groupBy(*by).pivot("split", ["TRAIN", "VAL", "TEST"]).agg(F.avg(value))


def fold_summary(folds: DataFrame, by: str | list[str], series: str | list[str]) -> DataFrame:
    """Walk-forward summary per pipeline: size, year label, errors, self-scaled MASE and accuracy.

    The MASE scale is the mean absolute difference of consecutive evaluated actuals of a series.
    """
    by, series = as_list(by), as_list(series)
    w = series_window([*series, *by], "fold")
    a, p = F.col("actual"), F.col("predicted")
    valid = folds.where(nm.is_valid(p)).withColumn("_d", F.abs(a - F.lag(a).over(w)))
    scale = F.avg("_d")
    out = valid.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.concat(F.min("fold").cast("string"), F.lit("-"), F.max("fold").cast("string")).alias("fold_years"),
        rmse(a, p).alias("rmse"),
        mae(a, p).alias("mae"),
        F.when(scale > 0, mae(a, p) / scale).alias("mase"),
        mape(a, p).alias("mape"),
    )
    return out.withColumn("accuracy_percent", nm.accuracy(F.col("mape")))
