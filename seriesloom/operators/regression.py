"""Multi-feature least squares and ridge, one fit per series, from orthogonal factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import orthogonal as ol
from seriesloom.operators.keys import as_list


def fit(df: DataFrame, key: str | list[str], xs: list[str], y: str, train: Column, ridge: float = 0.0) -> DataFrame:
    """Coefficients per series on standardised features (train mean and population deviation).

    For ``ridge=0`` this is ordinary least squares; otherwise the penalty acts on standardised
    coefficients and never on the intercept. Flat columns get weight 0 and a deviation of 1. One row per series: ``beta``, ``mu``, ``sd``,
    ``y_mean``, ``n`` and ``status``.
    """
    key = as_list(key)
    rows = df.where(train).na.drop(subset=[*key, *xs, y])
    found = ol.solved(ol.factors(rows, key, [F.lit(1.0), *[F.col(x) for x in xs], F.col(y)]), key, len(xs), ridge)
    enough = F.col("n") > len(xs)
    return found.select(
        *key, F.when(enough, F.col("beta")).alias("beta"), "mu", "sd", "y_mean", "n", F.when(enough, "ok").otherwise("too few rows").alias("status")
    )


def predicted(xs: list[str]) -> Column:
    """Fitted value from a joined coefficient row."""
    total = F.col("y_mean")
    for i, x in enumerate(xs):
        total = total + F.get("beta", i) * (F.col(x) - F.get("mu", i)) / F.get("sd", i)
    return total


def predict(df: DataFrame, coefs: DataFrame, key: str | list[str], xs: list[str], name: str = "predicted") -> DataFrame:
    """Score rows by their series' coefficients; rows of series without a model are left out."""
    used = coefs.select(*as_list(key), "beta", "mu", "sd", "y_mean")
    return df.join(used, as_list(key)).withColumn(name, predicted(xs)).drop("beta", "mu", "sd", "y_mean")


def lag_recursion(state: DataFrame, history: str, intercept: Column, weights: list[Column], steps: int) -> DataFrame:
    """Recursive forecast of an autoregression: each prediction becomes the newest lag of the next step.

    ``history`` is an array, newest last; one fold per series produces the whole horizon.
    """

    def step(path, _):
        new = intercept
        for i, weight in enumerate(weights, start=1):
            new = new + weight * F.try_element_at(path, F.lit(-i))
        return F.concat(path, F.array(new))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col(history), step)
    horizon = F.slice(path, F.size(history) + 1, steps)
    out = state.withColumn("_path", horizon)
    return out.select(*state.columns, F.posexplode("_path").alias("h", "predicted")).withColumn("h", F.col("h") + 1)
