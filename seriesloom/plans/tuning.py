"""Tuning jobs: candidate models of every member scored on the same three-way split."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators import arima as ar
from seriesloom.operators import boosting as bo
from seriesloom.operators import metrics as mt
from seriesloom.operators import regression as rg
from seriesloom.operators import simplex as sx
from seriesloom.operators import smoothing as sm
from seriesloom.operators import splits
from seriesloom.operators import trees as te
from seriesloom.operators.keys import as_list, series_window
from seriesloom.session import checkpointed

_COLUMNS = ["model", "params", "split", "rn", "actual", "predicted"]


def _shape(df: DataFrame, key: list[str], model: str, params: str, y: str) -> DataFrame:
    return df.select(
        *key, F.lit(model).alias("model"), F.lit(params).alias("params"), "split", F.col("rn").cast("int").alias("rn"),
        F.col(y).alias("actual"), "predicted",
    )


def split_rows(df: DataFrame, key, ts: str, min_rows: int = 48) -> DataFrame:
    """Feature rows with their split, materialised once because every candidate model reads them."""
    return checkpointed(splits.three_way(df, key, ts, min_rows=min_rows))


def linear_candidate(rows: DataFrame, key, xs: list[str], y: str) -> DataFrame:
    key = as_list(key)
    coefs = rg.fit(rows, key, xs, y, F.col("split") == "TRAIN")
    return _shape(rg.predict(rows, coefs, key, xs), key, "LINEAR", "{}", y)


def tree_candidates(
    rows: DataFrame, key, xs: list[str], y: str, boosted: Iterable[bo.Setting] = te.BOOSTED_GRID, forests: Iterable[dict] = te.FOREST_GRID
) -> list[DataFrame]:
    """One candidate per setting; the trees of a setting are trained on the train rows of all series together.

    Boosting ends when the validation rows have not gained for ``boosting.PATIENCE`` trees, and keeps the trees up to the best.
    """
    key, train, out = as_list(key), rows.where(F.col("split") == "TRAIN"), []
    boosted = list(boosted)
    watched = rows.where(F.col("split") != "TEST").withColumn("_is_val", F.col("split") == "VAL")
    for setting, model in zip(boosted, bo.fit(watched, xs, y, boosted, "_is_val") if boosted else [], strict=True):
        out.append(_shape(bo.scored(rows, model), key, "BOOSTED_TREES", json.dumps(asdict(setting) | {"trees": len(model.roots)}), y))
    for params in forests:
        out.append(_shape(te.score(te.fit_forest(train, xs, y, params), rows, xs), key, "RANDOM_FOREST", json.dumps(params), y))
    return out


def seasonal_naive_candidate(rows: DataFrame, key, y: str, season: int = 12) -> DataFrame:
    """Validation rows repeat the last train season; test rows repeat the last season of train and validation."""
    key = as_list(key)
    w = series_window(key, "rn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = rows.withColumns(
        {
            "_te": F.max(F.when(F.col("split") == "TRAIN", F.col("rn"))).over(whole),
            "_ve": F.max(F.when(F.col("split") != "TEST", F.col("rn"))).over(whole),
        }
    )
    end = F.when(F.col("split") == "TEST", F.col("_ve")).otherwise(F.col("_te"))
    return _shape(sm.seasonal_naive(ends, key, y, end, season), key, "SEASONAL_NAIVE", f'{{"season_length": {season}}}', y)


def _smoothing_candidate(rows: DataFrame, key, ts: str, y: str, model: str, season: int) -> DataFrame:
    """Weights by simplex search on train for the train and validation rows, on train and validation for the test rows."""
    key = as_list(key)
    known = rows.where(F.col("split") != "TEST").withColumn("_train", (F.col("split") == "TRAIN").cast("int"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(y).alias("y"))))
    arrays = known.groupBy(*key).agg(F.transform(pairs, lambda p: p["y"]).alias("_all"), F.sum("_train").cast("int").alias("_n"))
    fits_of = F.array(
        F.struct(F.lit(False).alias("_refit"), F.slice("_all", F.lit(1), F.col("_n")).alias("ys")), F.struct(F.lit(True).alias("_refit"), F.col("_all").alias("ys"))
    )
    series = arrays.select(*key, F.inline(fits_of))
    if model == "ETS":
        fits, ahead = sm.holt_winters(sx.with_best_weights(series, "ETS", season), season), sm.holt_winters_forecast(F.col("_h"), season)
    else:
        fits, ahead = sm.holt(sx.with_best_weights(series, "HOLT"), fitted=True), sm.holt_forecast(series, F.col("_h"))
    joined = rows.withColumn("_refit", F.col("split") == "TEST").join(fits, [*key, "_refit"]).withColumn("_h", F.col("rn") - F.size("ys"))
    value = F.when(F.col("_h") > 0, ahead).otherwise(F.get("f", (F.col("rn") - 1).cast("int")))
    return joined.withColumn("predicted", value).select(*rows.columns, "predicted")


def ets_candidate(rows: DataFrame, key, ts: str, y: str, season: int = 12) -> DataFrame:
    out = _smoothing_candidate(rows, key, ts, y, "ETS", season)
    return _shape(out, as_list(key), "ETS", f'{{"trend": "add", "seasonal": "add", "seasonal_periods": {season}}}', y)


def holt_candidate(rows: DataFrame, key, ts: str, y: str) -> DataFrame:
    return _shape(_smoothing_candidate(rows, key, ts, y, "HOLT", 12), as_list(key), "HOLT", '{"trend": "add", "damped": true}', y)


def seasonal_factors(rows: DataFrame, key, ts: str, y: str, part, season: int = 12) -> DataFrame:
    """Multiplicative seasonal factor per series and calendar month from a centred moving average, mean 1."""
    key = as_list(key)
    w = series_window(key, ts)
    inner, outer = w.rowsBetween(-(season // 2 - 1), season // 2 - 1), w.rowsBetween(-(season // 2), season // 2)
    centre = (F.sum(y).over(inner) + F.sum(y).over(outer)) / (2 * season)
    full = F.count(y).over(outer) == season + 1
    used = rows.where(part).withColumn("_ratio", F.when(full, F.col(y) / F.nullif(centre, F.lit(0.0))))
    raw = used.groupBy(*key, F.month(ts).alias("_month")).agg(F.avg("_ratio").alias("_raw"))
    mean = raw.groupBy(*key).agg(F.avg("_raw").alias("_mean"))
    return raw.join(mean, key).select(*key, "_month", F.coalesce(F.col("_raw") / F.col("_mean"), F.lit(1.0)).alias("factor"))


def theta_candidate(rows: DataFrame, key, ts: str, y: str, season: int = 12) -> DataFrame:
    """Seasonally adjusted theta forecasts. There are no fitted values, so train rows have no prediction."""
    key = as_list(key)
    parts = []
    for used, scored in (("TRAIN", "VAL"), ("TRAIN+VAL", "TEST")):
        part = F.col("split").isin(*used.split("+"))
        factors = seasonal_factors(rows, key, ts, y, part, season)
        adjusted = rows.withColumn("_month", F.month(ts)).join(factors, [*key, "_month"]).withColumn("_adj", F.col(y) / F.col("factor"))
        fits = sm.theta(sx.with_best_weights(sm.as_arrays(adjusted, key, ts, "_adj", part), "THETA"), season)
        joined = adjusted.where(F.col("split") == scored).join(fits, key)
        value = sm.theta_forecast(F.col("rn") - F.size("ys")) * F.col("factor")
        parts.append(joined.withColumn("predicted", value).select(*rows.columns, "predicted"))
    scored = reduce(lambda a, b: a.unionByName(b), parts)
    no_fit = rows.where(F.col("split") == "TRAIN").withColumn("predicted", F.lit(None).cast("double"))
    return _shape(scored.unionByName(no_fit), key, "THETA", f'{{"period": {season}}}', y)


def arima_candidates(rows: DataFrame, key, ts: str, y: str, grid: ar.Grid, model: str) -> DataFrame:
    """All orders of a grid that converge, each its own candidate named by its parameters, with their errors and information criteria."""
    key = as_list(key)
    return arima_scored(arima_fits(rows, key, ts, y, grid), key, grid, model)


def arima_fits(rows: DataFrame, key, ts: str, y: str, grid: ar.Grid) -> DataFrame:
    """Conditional-sum-of-squares fits of every order to the train rows, with status and the errors of each split."""
    return ar.fit_grid(rows, key, ts, y, F.col("split") == "TRAIN", grid, split="split", method="css")


def arima_scored(fits: DataFrame, key: list[str], grid: ar.Grid, model: str) -> DataFrame:
    fits = fits.where(F.col("status") == "ok")
    params = F.format_string(
        '{"order": [%d, %d, %d], "seasonal_order": [%d, %d, %d, ' + str(grid.season) + "]}", *[F.col(c) for c in ar.ORDER]
    )
    return fits.select(*key, F.lit(model).alias("model"), params.alias("params"), *ar.SCORES, "aic", "aicc")


def exogenous_candidate(rows: DataFrame, key, ts: str, xs: list[str], y: str, grid: ar.Grid) -> DataFrame:
    """Regression on the drivers, with the remainder forecast by an ARIMA of the grid's single order."""
    key = as_list(key)
    coefs = rg.fit(rows, key, xs, y, F.col("split") == "TRAIN")
    explained = rg.predict(rows, coefs, key, xs, "_fit").withColumn("_rest", F.col(y) - F.col("_fit"))
    fits = ar.fit_grid(explained, key, ts, "_rest", F.col("split") == "TRAIN", grid)
    rest = ar.predictions(fits, key).select(*key, "rn", F.col("predicted").alias("_rest_hat"))
    joined = explained.join(rest, [*key, "rn"]).withColumn("predicted", F.col("_fit") + F.col("_rest_hat"))
    return _shape(joined, key, "SARIMAX", '{"order": [1, 1, 1]}', y)


def candidate_scores(preds: list[DataFrame], key, scored: list[DataFrame] | None = None) -> DataFrame:
    """Train, validation and test errors of every (member, model, params) in one aggregate; ``scored`` candidates bring theirs."""
    columns = [*as_list(key), *_COLUMNS]
    merged = reduce(lambda a, b: a.unionByName(b), [p.select(*columns) for p in preds])
    counted = mt.split_bundle(merged, [*as_list(key), "model", "params"])
    return reduce(lambda a, b: a.unionByName(b.select(*counted.columns)), scored or [], counted)


def evaluate(rows: DataFrame, key, ts: str, y: str, evaluators: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Test errors of several models on one common split, with the date ranges they were made from.

    ``rows`` carries ``split`` (TRAIN or TEST). An evaluator returns the same rows with ``predicted``, fitted on
    the train rows only. MASE is scaled by the train rows.
    """
    key = as_list(key)
    parts = [
        run(rows).select(*key, F.lit(name).alias("model"), "split", F.col(y).alias("actual"), "predicted")
        for name, run in evaluators.items()
    ]
    test = reduce(lambda a, b: a.unionByName(b), parts).where(F.col("split") == "TEST")
    train, held = F.when(F.col("split") == "TRAIN", F.col(ts)), F.when(F.col("split") == "TEST", F.col(ts))
    ranges = rows.groupBy(*key).agg(
        F.min(train).alias("train_start"), F.max(train).alias("train_end"), F.min(held).alias("test_start"), F.max(held).alias("test_end")
    )
    scales = mt.naive_scale(rows.where(F.col("split") == "TRAIN"), key, ts, y)
    return mt.with_mase(mt.bundle(test, [*key, "model"]), scales, key).join(ranges, key)
