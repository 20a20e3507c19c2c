"""Closed-form trends per series: plain aggregates, no iteration and no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.operators.keys import as_list, series_window

_ZERO = 0.0


def _nz(c: Column) -> Column:
    return F.nullif(c, F.lit(_ZERO))


def quadratic_trend(df: DataFrame, key: str | list[str], x: str, y: str, train: Column) -> DataFrame:
    """Least-squares ``a + b*(x-m) + c*(x-m)^2`` on the train rows of each series, ``m`` the train mean.

    One coefficient row per series. Coefficients are NULL below three rows or when x has too few values.
    """
    key = as_list(key)
    rows = df.where(train)
    mean = rows.groupBy(*key).agg(F.avg(x).alias("x_mean"))
    xc, yv = F.col(x) - F.col("x_mean"), F.col(y)
    sums = rows.join(mean, key).groupBy(*key, "x_mean").agg(
        F.count(yv).cast("double").alias("n"),
        F.sum(xc * xc).alias("s2"),
        F.sum(xc * xc * xc).alias("s3"),
        F.sum(xc * xc * xc * xc).alias("s4"),
        F.sum(yv).alias("t0"),
        F.sum(xc * yv).alias("t1"),
        F.sum(xc * xc * yv).alias("t2"),
    )
    n, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s2", "s3", "s4", "t0", "t1", "t2"))
    quad = (t2 - s2 * t0 / n - s3 * t1 / _nz(s2)) / _nz(s4 - s2 * s2 / n - s3 * s3 / _nz(s2))
    return sums.select(*key, "x_mean", "n", "s2", "s3", "t0", "t1", F.when(n >= 3, quad).alias("c")).select(
        *key, "x_mean", ((t0 - s2 * F.col("c")) / n).alias("a"), ((t1 - s3 * F.col("c")) / _nz(s2)).alias("b"), "c"
    )


def predict_quadratic(df: DataFrame, coefs: DataFrame, key: str | list[str], x: str) -> DataFrame:
    xc = F.col(x) - F.col("x_mean")
    fitted = F.col("a") + F.col("b") * xc + F.col("c") * xc * xc
    return df.join(coefs, as_list(key)).withColumn("predicted", fitted).drop("x_mean", "a", "b", "c")


def linear_trend(df: DataFrame, key: str | list[str], x: str, y: str, train: Column) -> DataFrame:
    kept_x, kept_y = F.when(train, F.col(x)), F.when(train, F.col(y))
    return df.groupBy(*as_list(key)).agg(
        F.regr_intercept(kept_y, kept_x).alias("intercept"), F.regr_slope(kept_y, kept_x).alias("slope")
    )


def ridge_trend(df: DataFrame, key: str | list[str], x: str, y: str, train: Column, alpha: float = 1.0) -> DataFrame:
    """One-feature ridge with a free intercept: slope = Sxy / (Sxx + alpha)."""
    kept_x, kept_y = F.when(train, F.col(x)), F.when(train, F.col(y))
    slope = F.regr_sxy(kept_y, kept_x) / (F.regr_sxx(kept_y, kept_x) + F.lit(alpha))
    return df.groupBy(*as_list(key)).agg(
        (F.avg(kept_y) - slope * F.avg(kept_x)).alias("intercept"), slope.alias("slope")
    )


def predict_line(df: DataFrame, coefs: DataFrame, key: str | list[str], x: str, name: str = "predicted") -> DataFrame:
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    return df.join(coefs, as_list(key)).withColumn(name, fitted).drop("intercept", "slope")


def expanding_line(df: DataFrame, key: str | list[str], x: str, y: str) -> DataFrame:
    """For every row, the straight line fitted to all earlier rows of its series, evaluated at the row.

    Running sums replace one refit per fold: a walk-forward of T folds costs T rows, not T*T.
    """
    w = series_window(key, x)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    origin = F.first(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    base = df.withColumn("_x", (F.col(x) - origin).cast("double"))
    n = F.count(F.col(y)).over(past).cast("double")
    sx, sy = F.sum("_x").over(past), F.sum(y).over(past)
    sxx, sxy = F.sum(F.col("_x") * F.col("_x")).over(past), F.sum(F.col("_x") * F.col(y)).over(past)
    base = base.withColumns({"_n": n, "_sx": sx, "_sy": sy, "_sxx": sxx, "_sxy": sxy})
    slope = (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / _nz(
        F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx")
    )
    level = (F.col("_sy") - slope * F.col("_sx")) / _nz(F.col("_n"))
    return base.withColumn("predicted", level + slope * F.col("_x")).drop("_x", "_n", "_sx", "_sy", "_sxx", "_sxy")


def choose_by_validation(df: DataFrame, key: str | list[str], metric: str, model: str, order: list[str]) -> DataFrame:
    """Best model row per series by a validation metric; on a tie the model named first wins."""
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(F.col(model) == name, i).otherwise(place)
    rest = [c for c in df.columns if c not in as_list(key)]
    best = F.min_by(F.struct(*rest), F.struct(F.coalesce(F.col(metric), F.lit(float("inf"))), place))
    return df.groupBy(*as_list(key)).agg(best.alias("_r")).select(*as_list(key), "_r.*")


def share_forecast(df: DataFrame, share: str, total: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Usable share, and the member value it gives, rounded half-even to whole units.

    Shares of lines and trees are taken as they are; ``limits`` (``numeric.SHARE_RANGE``) hold those of autoregressive models.
    """
    return df.withColumn("predicted_proportion", nm.clean_share(F.col(share), limits)).withColumn(
        "predicted_member", nm.half_even(F.col("predicted_proportion") * F.col(total), 0).cast("long")
    )
