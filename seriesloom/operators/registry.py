"""Fitted models of every kind as rows of one table, and one scoring pass that dispatches on the kind.

A model row is (name, kind, member, features, numbers): the numbers are named arrays of coefficients, knots, tree nodes or series ends, so models of all kinds live in one versioned store and are loaded
without the code that fitted them. Requests meet the models of their member in a co-grouped pass; requests are reduced to distinct (member, month, features) first, so a group is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.operators import css
from seriesloom.operators.boosting import Ensemble

MODEL = "name string, kind string, member string, features array<string>, numbers map<string, array<double>>"
ORDER = ("p", "d", "q", "sp", "sd", "sq")


def month_number(date: Column) -> Column:
    """Months since year 0, so that steps between months are differences."""
    return F.year(date) * 12 + F.month(date)


def _rows(df: DataFrame, name: str, kind: str, key: str, features: list[str], numbers: dict[str, Column]) -> DataFrame:
    pairs = [c for n, v in numbers.items() for c in (F.lit(n), v.cast("array<double>"))]
    given = F.array(*(F.lit(f) for f in features)) if features else F.array().cast("array<string>")
    return df.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.col(key).alias("member"), given.alias("features"), F.create_map(*pairs).alias("numbers"))


def linear_models(coefs: DataFrame, key: str, xs: list[str], name: str = "linear") -> DataFrame:
    """Coefficient rows of ``regression.fit``; series without a fit give no model."""
    numbers = {"beta": F.col("beta"), "mu": F.col("mu"), "sd": F.col("sd"), "level": F.array("y_mean")}
    return _rows(coefs.where("status = 'ok'"), name, "linear", key, xs, numbers)


def piecewise_models(fits: DataFrame, key: str, first_month: Column, growth: str = "linear", regressors: list[str] | None = None, name: str = "piecewise") -> DataFrame:
    """Rows of ``piecewise.fit_trend``; ``first_month`` is the month number of a series' first value."""
    numbers = {c: F.col(f"m.{c}") for c in ("beta", "knots", "extra", "mu", "sd")}
    numbers |= {"cap": F.array("cap"), "rows": F.array("n_obs"), "first": F.array(first_month), "logistic": F.array(F.lit(float(growth == "logistic")))}
    return _rows(fits, name, "piecewise", key, regressors or [], numbers)


def arima_models(fits: DataFrame, series: DataFrame, key: str, last_month: Column, season: int, name: str = "arima") -> DataFrame:
    """Rows of ``arima.fit_grid`` by conditional sums of squares, one order per series, with the values ``ys`` they continue. Fits that did not converge give no model."""
    numbers = {"order": F.array(*(F.col(c) for c in ORDER)), "season": F.array(F.lit(season)), "beta": F.col("beta"), "ys": F.col("ys"), "last": F.array(last_month)}
    return _rows(fits.where("status = 'ok'").join(series, key), name, "arima", key, [], numbers)


def tree_model(spark: SparkSession, ensemble: Ensemble, member: str, name: str = "trees") -> DataFrame:
    numbers = {c: [float(x) for x in getattr(ensemble, c)] for c in ("feature", "threshold", "left", "right", "value", "roots")}
    numbers |= {"base": [ensemble.base], "depth": [float(ensemble.depth)]}
    return spark.createDataFrame([(name, "trees", member, list(ensemble.features), numbers)], MODEL)


def _linear(n: dict, x: np.ndarray, month: np.ndarray) -> np.ndarray:
    return n["level"][0] + ((x - n["mu"]) / n["sd"]) @ n["beta"]


def _piecewise(n: dict, x: np.ndarray, month: np.ndarray) -> np.ndarray:
    t = (month - n["first"][0]) / max(n["rows"][0] - 1, 1)
    raw = n["beta"][0] + n["beta"][1] * t + np.maximum(t[:, None] - n["knots"][None], 0.0) @ n["beta"][2:]
    if len(n["extra"]):
        raw = raw + ((x - n["mu"]) / n["sd"]) @ n["extra"]
    return n["cap"][0] / (1 + np.exp(-raw)) if n["logistic"][0] else raw


def _trees(n: dict, x: np.ndarray, month: np.ndarray) -> np.ndarray:
    whole = {c: n[c].astype(int) for c in ("feature", "left", "right", "roots")}
    return Ensemble((), n["base"][0], whole["feature"], n["threshold"], whole["left"], whole["right"], n["value"], whole["roots"], int(n["depth"][0])).predict(x)


def _arima(n: dict, x: np.ndarray, month: np.ndarray) -> np.ndarray:
    """Steps after the last value follow the model; at or before it the last value holds."""
    steps = (month - n["last"][0]).astype(int)
    path = css.continued(n["ys"], dict(zip(ORDER, n["order"].astype(int).tolist(), strict=True)), int(n["season"][0]), n["beta"], max(int(steps.max(initial=0)), 0))
    return np.concatenate([n["ys"][-1:], path])[np.maximum(steps, 0)]


SCORERS = {"linear": _linear, "piecewise": _piecewise, "trees": _trees, "arima": _arima}


def score(models: DataFrame, requests: DataFrame, features: list[str], member: str = "member", month: str = "month") -> DataFrame:
    """(member, month, features, name, predicted): every model of a member on every distinct request. Members without models, and predictions that are not finite, give no row."""
    asked = requests.select(F.col(member).alias("member"), F.col(month).cast("long").alias("month"), *(F.col(f).cast("double").alias(f) for f in features)).distinct()
    schema = T.StructType([*asked.schema.fields, T.StructField("name", T.StringType()), T.StructField("predicted", T.DoubleType())])
    names = schema.names

    def run(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        parts = [rows.iloc[:0].assign(name=pd.Series(dtype=object), predicted=pd.Series(dtype=float))]
        for model in held.itertuples(index=False):
            numbers = {k: np.asarray(v, dtype=float) for k, v in dict(model.numbers).items()}
            x = rows[list(model.features)].to_numpy(dtype=float) if len(model.features) else np.zeros((len(rows), 0))
            with np.errstate(all="ignore"):
                predicted = SCORERS[model.kind](numbers, x, rows["month"].to_numpy(dtype=float))
            parts.append(rows.assign(name=model.name, predicted=predicted)[np.isfinite(predicted)])
        filled = [p for p in parts if len(p)] or parts[:1]
        return pd.concat(filled)[names]

    return asked.groupBy("member").cogroup(models.groupBy("member")).applyInPandas(run, schema)


def wide(scored: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """One column per model name and ``ensemble``, the mean over the models that have a prediction."""
    return scored.groupBy(*by).agg(*(F.max(F.when(F.col("name") == n, F.col("predicted"))).alias(n) for n in names), F.avg("predicted").alias("ensemble"), F.count("*").alias("n_models"))

