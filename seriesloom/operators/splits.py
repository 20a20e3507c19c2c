"""Chronological splits by row rank or by year, and the size rules that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.keys import as_list, series_window


def ranked(df: DataFrame, key: str | list[str], ts: str) -> DataFrame:
    """Add 1-based position ``rn`` and series length ``n`` on the shared window."""
    w = series_window(key, ts)
    return df.withColumn("rn", F.row_number().over(w)).withColumn(
        "n", F.max("rn").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    )


def two_way(df: DataFrame, key: str | list[str], ts: str, ratio: float, lo: int = 1, hi: int = 1) -> DataFrame:
    """TRAIN is the first int(n*ratio) rows, kept within [lo, n-hi]."""
    cut = F.greatest(F.lit(lo), F.least(F.floor(F.col("n") * F.lit(ratio)), F.col("n") - hi))
    return ranked(df, key, ts).withColumn("split", F.when(F.col("rn") <= cut, "TRAIN").otherwise("TEST"))


def three_way_bounds(train_ratio: float, val_ratio: float) -> tuple[Column, Column]:
    """Last TRAIN and last VAL position for a series of length ``n``."""
    train_end = F.greatest(F.lit(24), F.floor(F.col("n") * F.lit(train_ratio)))
    val_end = F.least(
        F.greatest(train_end + 12, F.floor(F.col("n") * F.lit(train_ratio + val_ratio))), F.col("n") - 12
    )
    return train_end, val_end


def three_way(
    df: DataFrame, key: str | list[str], ts: str, train_ratio: float = 0.7, val_ratio: float = 0.1, min_rows: int = 48
) -> DataFrame:
    """TRAIN / VAL / TEST in time order. Shorter series are left out, since their parts would overlap."""
    train_end, val_end = three_way_bounds(train_ratio, val_ratio)
    label = F.when(F.col("rn") <= train_end, "TRAIN").when(F.col("rn") <= val_end, "VAL").otherwise("TEST")
    return ranked(df, key, ts).where(F.col("n") >= min_rows).withColumn("split", label)


def by_year(df: DataFrame, year: Column, train_until: int | Column, val_until: int | Column) -> DataFrame:
    label = F.when(year <= train_until, "TRAIN").when(year <= val_until, "VAL").otherwise("TEST")
    return df.withColumn("split", label)


def members_with_sizes(df: DataFrame, key: str | list[str], sizes: dict[str, int]) -> DataFrame:
    """Keep rows of members that have at least the given number of rows in each split."""
    counts = df.groupBy(*as_list(key)).agg(
        *[F.count(F.when(F.col("split") == s, 1)).alias(f"_n_{s}") for s in sizes]
    )
    ok = F.lit(True)
    for s, need in sizes.items():
        ok = ok & (F.col(f"_n_{s}") >= need)
    return df.join(counts.where(ok).select(*as_list(key)), as_list(key), "left_semi")


def min_size(df: DataFrame, key: str | list[str], rows: int) -> DataFrame:
    """Keep series with at least ``rows`` rows. The count is a partial aggregate, so a hot series is no single task."""
    big = df.groupBy(*as_list(key)).count().where(F.col("count") >= rows)
    return df.join(big.drop("count"), as_list(key), "left_semi")


def require_rows(df: DataFrame, rows: int, message: str) -> DataFrame:
    """Fail at once when the whole table has fewer than ``rows`` rows; at most so many are counted. Otherwise the table passes unchanged.

    A check inside the plan would be optimised away together with an empty table.
    """
    if df.limit(rows).count() < rows:
        raise ValueError(message)
    return df
