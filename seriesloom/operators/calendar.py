"""Calendar operators: regular grids, yearly/monthly conversion, forecast horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import time as tm
from seriesloom.operators.keys import as_list, one_value, series_window
from seriesloom.session import checkpointed


def month_buckets(df: DataFrame, key: list[str], ts: str, aggs: dict[str, Column]) -> DataFrame:
    """Aggregate raw rows to one row per series and month; partial sums are made before the shuffle."""
    return df.groupBy(*key, tm.month_start(F.col(ts)).alias("ts")).agg(
        *[c.alias(n) for n, c in aggs.items()]
    )


def month_grid(start: Column, end: Column) -> Column:
    return F.explode(F.sequence(start, end, F.expr("interval 1 month")))


def regularise(cells: DataFrame, key: str | list[str], ts: str = "ts", shared_range: bool = True) -> DataFrame:
    """Put every series on the full monthly calendar; months without a cell get NULL measures.

    ``shared_range`` uses the range of the whole table, otherwise each series keeps its own
    range. The grid comes from ``sequence``, so no calendar table is joined or crossed. The
    cells are used for the member list, the range and the values, so they are materialised
    once: the raw rows behind them are read a single time.
    """
    key = as_list(key)
    cells = checkpointed(cells)
    if shared_range:
        first, last = one_value(cells, F.min(ts)), one_value(cells, F.max(ts))
        members = cells.select(*key).distinct()
        grid = members.select(*key, month_grid(first, last).alias(ts))
    else:
        spans = cells.groupBy(*key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
        grid = spans.select(*key, month_grid(F.col("_lo"), F.col("_hi")).alias(ts))
    return grid.join(cells, [*key, ts], "left")


def yearly_to_monthly(
    df: DataFrame, key: str | list[str], year: str, values: list[str], min_years: int = 2
) -> DataFrame:
    """Straight line from one year's value to the next over its twelve months.

    The last year continues with the previous year's difference. Series with fewer than
    ``min_years`` rows are dropped, since they have no difference.
    """
    key = as_list(key)
    w = series_window(key, year)
    steps = {}
    for v in values:
        ahead, back = F.lead(v).over(w) - F.col(v), F.col(v) - F.lag(v).over(w)
        steps[f"_d_{v}"] = F.coalesce(ahead, back)
    size = F.max("_rn").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = (
        df.select(*key, year, *values)
        .withColumns({"_rn": F.row_number().over(w), **steps})
        .withColumn("_n", size)
        .where(F.col("_n") >= min_years)
        .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    )
    frac = (F.col("month") - 1) / F.lit(12.0)
    return out.select(
        *key,
        F.col(year).cast("int").alias("year"),
        "month",
        tm.first_of_month(F.col(year).cast("int"), F.col("month")).alias("ts"),
        *[(F.col(v) + frac * F.col(f"_d_{v}")).alias(v) for v in values],
    )


def yearly_to_month_grid(df: DataFrame, key: str | list[str], year: str) -> DataFrame:
    """January anchors of a possibly gappy yearly table on the full monthly grid of each series.

    Months between anchors are NULL here; interpolation over the grid fills them.
    """
    key = as_list(key)
    spans = df.groupBy(*key).agg(F.min(year).cast("int").alias("_lo"), F.max(year).cast("int").alias("_hi"))
    grid = spans.select(
        *key,
        month_grid(F.make_date("_lo", F.lit(1), F.lit(1)), F.make_date("_hi", F.lit(12), F.lit(1))).alias("ts"),
    )
    anchors = df.withColumn("ts", F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(1))).drop(year)
    return (
        grid.join(anchors, [*key, "ts"], "left")
        .withColumn("year", F.year("ts"))
        .withColumn("month", F.month("ts"))
    )


def year_horizon(last_years: DataFrame, last_year: str, steps: int) -> DataFrame:
    """The ``steps`` years after each series' last one."""
    return last_years.withColumn(
        "year", F.explode(F.sequence(F.col(last_year) + 1, F.col(last_year) + steps))
    )


def month_horizon(members: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Every month of a range for each member row, with its calendar parts."""
    first, last = (F.to_date(F.lit(d)) if isinstance(d, str) else d for d in (start, end))
    return members.withColumn("ts", month_grid(first, last)).withColumns(
        {
            "year": F.year("ts"),
            "month": F.month("ts"),
            "fractional_year": tm.fractional_year(F.col("ts")),
        }
    )


def spread_flat(df: DataFrame, key: str | list[str], year: str, value: str) -> DataFrame:
    """A yearly value repeated in its twelve months."""
    return df.withColumn("_m", F.explode(F.sequence(F.lit(1), F.lit(12)))).select(
        *as_list(key), tm.first_of_month(F.col(year).cast("int"), F.col("_m")).alias("ts"), value
    )


def after_last_year(df: DataFrame, last_year: Column) -> DataFrame:
    """Months from Dec-31 of the last year plus one month on, so the first month kept is February."""
    return df.where(F.col("ts") >= tm.first_month_after_year(last_year))
