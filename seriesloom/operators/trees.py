"""Settings of tree ensembles, bagged trees trained on all series together, and step-by-step recursive forecasts of any fitted model. Boosted trees are in ``boosting``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.boosting import Setting
from seriesloom.session import checkpointed

# The boosted and bagged settings that are tried.
BOOSTED_GRID = (
    Setting(rounds=800, depth=1, step=0.02, row_share=0.8, feature_share=0.8, least_rows=8),
    Setting(rounds=1200, depth=2, step=0.01, row_share=0.8, feature_share=0.8, least_rows=10),
)
FOREST_GRID = (
    {"numTrees": 200, "maxDepth": 4, "minInstancesPerNode": 8},
    {"numTrees": 300, "maxDepth": 5, "minInstancesPerNode": 10},
)
SEED = 42


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(df)


def fit_forest(df: DataFrame, features: list[str], target: str, params: dict):
    return RandomForestRegressor(featuresCol="_x", labelCol=target, seed=SEED, **params).fit(assemble(df, features))


def score(model, df: DataFrame, features: list[str], name: str = "predicted") -> DataFrame:
    out = model.transform(assemble(df, features)).drop("_x")
    return out.withColumnRenamed("prediction", name)


def recursive_forecast(
    model,
    state: DataFrame,
    features: Callable[[Column, Column], dict[str, Column]],
    steps: int,
    next_step: Callable[[Column], Column],
    checkpoint_every: int = 6,
) -> DataFrame:
    """Forecast ``steps`` ahead for all series at once: each step scores every series in one transform.

    ``state`` has the array ``ys`` (newest last) and the last time ``at``. ``features`` turns (ys, next time) into the
    model's inputs. The lineage is cut by a reliable checkpoint every few steps.
    """
    keep = state.columns
    current = state.withColumn("_path", F.array().cast("array<double>"))
    for i in range(1, steps + 1):
        nxt = next_step(F.col("at"))
        inputs = features(F.col("ys"), nxt)
        ready = current.withColumns({f"_f_{n}": c for n, c in inputs.items()})
        scored = score(model, ready, [f"_f_{n}" for n in inputs], "_p")
        current = scored.select(
            *[c for c in keep if c not in ("ys", "at")],
            F.concat(F.slice("ys", 2, F.size("ys") - 1), F.array("_p")).alias("ys"),
            nxt.alias("at"),
            F.concat("_path", F.array("_p")).alias("_path"),
        )
        if i % checkpoint_every == 0 and i < steps:
            current = checkpointed(current)
    return current.select(
        *[c for c in keep if c not in ("ys", "at")], F.posexplode("_path").alias("h", "predicted")
    ).withColumn("h", F.col("h") + 1)
