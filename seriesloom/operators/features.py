"""Lag, rolling and calendar features. All windows are the same, so a frame is shuffled and sorted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import time as tm
from seriesloom.operators.keys import as_list, series_window


def lags(df: DataFrame, key: str | list[str], ts: str, spec: dict[str, tuple[str, int]]) -> DataFrame:
    """``spec`` maps a new column to (source column, steps back)."""
    w = series_window(key, ts)
    return df.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in spec.items()})


def driver_lags(df: DataFrame, key: str | list[str], ts: str, drivers: list[str], suffix: str = "_lag1") -> DataFrame:
    return lags(df, key, ts, {f"{d}{suffix}": (d, 1) for d in drivers})


def rolling_mean(c: str, key: str | list[str], ts: str, size: int, min_periods: int | None = None) -> Column:
    """Mean of the last ``size`` rows including the current one; NULL below ``min_periods`` values."""
    w = series_window(key, ts).rowsBetween(-(size - 1), 0)
    need = size if min_periods is None else min_periods
    return F.when(F.count(c).over(w) >= need, F.avg(c).over(w))


def proxy_from_mean(c: str, key: str | list[str], ts: str, size: int, factor: float = 0.5) -> Column:
    """Stand-in for an absent driver: a scaled rolling mean of another one."""
    return rolling_mean(c, key, ts, size, min_periods=1) * F.lit(factor)


def difference(c: str, key: str | list[str], ts: str, steps: int = 1) -> Column:
    return F.col(c) - F.lag(c, steps).over(series_window(key, ts))


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    d = F.col(ts)
    return df.withColumns(
        {
            "fractional_year": tm.fractional_year(d),
            "month_sin": tm.month_sin(d),
            "month_cos": tm.month_cos(d),
        }
    )


def add_time_features(df: DataFrame, target: str, key: str | list[str], ts: str = "ts") -> DataFrame:
    """lag 1, lag 12, three-step rolling mean and the cyclical month, per series."""
    df = lags(df, key, ts, {"lag_1": (target, 1), "lag_12": (target, 12)})
    df = df.withColumn("rolling_mean_3", rolling_mean(target, key, ts, 3))
    return calendar_features(df, ts)


def yearly_trend_features(df: DataFrame, key: str | list[str], year: str, target: str, mean_year: Column) -> DataFrame:
    """Centred year, its square and the two previous values."""
    df = lags(df, key, year, {f"{target}_lag1": (target, 1), f"{target}_lag2": (target, 2)})
    return df.withColumn("year_centered", F.col(year) - mean_year).withColumn(
        "year_centered2", F.pow("year_centered", F.lit(2.0))
    )


def proportion(df: DataFrame, member_total: str, grand_total: str) -> DataFrame:
    return df.withColumn("proportion", F.col(member_total) / F.nullif(F.col(grand_total), F.lit(0.0)))


def scaler(df: DataFrame, key: str | list[str], columns: list[str], train: Column) -> DataFrame:
    """Mean and population deviation of the train rows of each series; a zero deviation becomes 1."""
    aggs = []
    for c in columns:
        kept = F.when(train, F.col(c))
        sd = F.stddev_pop(kept)
        aggs += [F.avg(kept).alias(f"mean_{c}"), F.when(sd == 0, 1.0).otherwise(sd).alias(f"std_{c}")]
    return df.groupBy(*as_list(key)).agg(*aggs)


def standardise(df: DataFrame, stats: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}
    drop = [f"{p}_{c}" for c in columns for p in ("mean", "std")]
    return df.join(stats, as_list(key)).withColumns(scaled).drop(*drop)


def correlations(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Correlation of every column with the target, one pass over the table, in long form."""
    wide = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in columns])
    return wide.select(F.inline(pairs))
