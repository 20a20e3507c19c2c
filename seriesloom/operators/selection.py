"""Candidate scoring, leaderboards and fit diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.operators.keys import as_list
from seriesloom.operators.metrics import pivot_splits
from seriesloom.operators.ranking import first_per_group, global_rank


def with_selection(candidates: DataFrame) -> DataFrame:
    train, val = F.col("train_mape"), F.col("val_mape")
    return candidates.withColumns(
        {"val_train_ratio": nm.val_train_ratio(train, val), "selection_score": nm.selection_score(train, val)}
    )


def _missing_last(c: str) -> Column:
    """A score to sort by: NULL and NaN, as a failed model leaves them, come after every number."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float("inf"))), F.lit(float("inf")))


def _order(*tie: str) -> Column:
    return F.struct(_missing_last("selection_score"), _missing_last("val_rmse"), *tie)


def best_per_family(candidates: DataFrame, tie: str = "params") -> DataFrame:
    """Best whole row per model family, ranked 1..n by score."""
    best = first_per_group(with_selection(candidates), "model", F.struct(_order(), _missing_last("test_rmse"), tie))
    return global_rank(best, [_missing_last("selection_score"), _missing_last("val_rmse"), F.col("model")], "rank_by_val")


def best_per_member(candidates: DataFrame, key: str | list[str], tie: str = "model") -> DataFrame:
    best = first_per_group(with_selection(candidates), as_list(key), F.struct(_order(), _missing_last("test_rmse"), tie))
    return best.withColumn("rank_by_val", F.lit(1))


def member_leaderboard(candidates: DataFrame, key: str | list[str]) -> DataFrame:
    """Best model of each member, and the member's place among all members."""
    best = best_per_member(candidates, key)
    order = [*(_missing_last(c) for c in ("selection_score", "val_rmse", "test_rmse")), *[F.col(k) for k in as_list(key)]]
    return global_rank(best, order, "overall_rank_by_val")


def diagnose(metrics: DataFrame, by: list[str]) -> DataFrame:
    wide = pivot_splits(metrics, by, "mape")
    train, val = F.col("TRAIN"), F.col("VAL")
    return wide.withColumns(
        {
            "overfitting_ratio": val / F.nullif(train, F.lit(0.0)),
            "status": nm.fit_status(train, val),
            "level": nm.overfit_level(train, val),
        }
    )


def generalisation_gap(metrics: DataFrame, by: list[str]) -> DataFrame:
    """TEST minus VAL error."""
    return pivot_splits(metrics, by, "mape").withColumn("gap", F.col("TEST") - F.col("VAL"))
