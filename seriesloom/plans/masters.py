"""Whole-table preparation jobs: masters, evaluation frames and scraped statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.functions import text as tx
from seriesloom.functions import time as tm
from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import fill, joins, shaping, splits
from seriesloom.operators.keys import as_list
from seriesloom.operators.ranking import dedupe_keep_last

# Columns a statistics table may bring, after heading clean-up, and their other spellings.
STAT_COLUMNS = [
    "Year",
    "Population",
    "Yearly_Percent_Change",
    "Yearly_Change",
    "Migrants_net",
    "Median_Age",
    "Fertility_Rate",
    "Density_P_Km2",
    "Urban_Pop_Percent",
    "Urban_Population",
    "World_Share",
    "World_Population",
    "Global_Rank",
]
STAT_ALIASES = {
    "Yearly_Change": ["Yearly_Change_"],
    "Migrants_net": ["Migrants_net_"],
    "Density_P_Km2": ["Density_PKm2", "Density"],
    "Urban_Pop_Percent": ["Urban_Pop"],
    "World_Share": ["Countrys_Share_of_World_Pop"],
}


def yearly_master(measures: list[DataFrame], values: list[str]) -> DataFrame:
    """Full outer join of two-column measure tables on the year, gaps interpolated, edges held.

    The yearly table has one row per calendar year, so the constant series key keeps a bounded window.
    """
    wide = joins.join_chain(measures[0], measures[1:], "year", "full").withColumn("member", F.lit("TOTAL"))
    return fill.interpolate(wide, "member", "year", values, edge="both")


def monthly_master(yearly: DataFrame, target: str, drivers: list[str]) -> DataFrame:
    """Yearly table to months, features and driver lags, incomplete months dropped."""
    monthly = cal.yearly_to_monthly(yearly, "member", "year", [target, *drivers])
    featured = ft.add_time_features(monthly, target, "member")
    return ft.driver_lags(featured, "member", "ts", drivers).na.drop("any")


def member_monthly_master(members: DataFrame, national: DataFrame, target: str, national_target: str, measures: list[str] | None = None) -> DataFrame:
    """Member years to months, the national master joined on the month, grouped features and national lags.

    ``measures`` are further columns of the members brought to months beside the target, on which the features are built.
    """
    monthly = cal.yearly_to_monthly(members, "member", "year", [target, *(measures or [])])
    nat = national.drop("year", "month", "member", "lag_1", "lag_12", "rolling_mean_3", "fractional_year", "month_sin", "month_cos")
    wide = ft.add_time_features(monthly.join(nat, "ts", "left"), target, "member")
    out = ft.lags(wide, "member", "ts", {"national_lag_1": (national_target, 1), "national_lag_12": (national_target, 12)})
    return out.na.drop("any")


def anchored_member_months(yearly: DataFrame, key: str = "member") -> DataFrame:
    """Year-end observations put on the month grid of their series and joined by straight lines.

    The observation of a year sits on its December; months before the first one stay NULL.
    """
    anchors = yearly.select(key, tm.month_start(tm.year_end(F.col("year"))).alias("ts"), "total")
    grid = cal.regularise(anchors, key, shared_range=False)
    return fill.interpolate(grid, key, "ts", ["total"], edge="forward")


def evaluation_frame(
    df: DataFrame, key: str | list[str], year: str, target: str, drivers: list[str], ratio: float = 0.8, proxy: tuple[str, str] | None = None
) -> DataFrame:
    """Proxy driver, gap filling, centred year, lags, complete rows only, chronological split.

    ``proxy=(missing, source)`` adds the missing driver as half the 3-row rolling mean of the source and
    flags it in ``is_proxy``. The year is centred on the mean of the train part.
    """
    key = as_list(key)
    if proxy:
        missing, source = proxy
        df = df.withColumn(missing, ft.proxy_from_mean(source, key, year, 3)).withColumn("is_proxy", F.lit(True))
        drivers = [*drivers, missing]
    df = fill.interpolate(df, key, year, drivers, edge="both")
    df = fill.fill_both_ways(df, key, year, drivers)
    df = ft.lags(df, key, year, {f"{target}_lag1": (target, 1), f"{target}_lag2": (target, 2)})
    df = ft.driver_lags(df, key, year, drivers).na.drop("any")
    df = splits.two_way(df, key, year, ratio, lo=3, hi=2)
    w = ft.series_window(key, year)
    mean = F.avg(F.when(F.col("split") == "TRAIN", F.col(year))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("year_centered", F.col(year) - mean).withColumn("year_centered2", F.pow("year_centered", F.lit(2.0)))


def standardise_statistics(raw: DataFrame, extra_key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """A scraped statistics table of text cells made numeric, one row per year, with derived columns.

    Headings are normalised and aliased, texts become numbers, rows without year or
    value are dropped, the row with the greatest ``order`` wins a duplicate year, and density and urban value are
    derived when the table lacks them.
    """
    key = extra_key or []
    out = shaping.clean_headings(raw)
    ranks = [c for c in out.columns if c.endswith("Global_Rank")]  # the heading starts with the country's name
    out = shaping.apply_aliases(out, {**STAT_ALIASES, "Global_Rank": ranks})
    wanted = [c for c in STAT_COLUMNS if c in out.columns]
    keep = [*key, *([order] if order and order not in key else [])]
    out = out.select(*keep, *[tx.to_number(F.col(c)).alias(c) for c in wanted])
    out = out.na.drop(subset=["Year", "Population"]).withColumn("Year", F.col("Year").cast("int"))
    if order:
        out = dedupe_keep_last(out, [*key, "Year"], F.col(order))
        out = out.drop(order) if order not in key else out
    out = out.withColumnsRenamed({"Population": "National_Population", "Density_P_Km2": "Population_Density"})
    extra = {}
    if "Population_Density" not in out.columns:
        extra["Population_Density"] = nm.density(F.col("National_Population"))
    if "Urban_Population" not in out.columns and "Urban_Pop_Percent" in out.columns:
        extra["Urban_Population"] = nm.part_of(F.col("National_Population"), F.col("Urban_Pop_Percent"))
    return out.withColumns({**extra, "Date": tm.year_end(F.col("Year"))})


def gappy_years_to_months(yearly: DataFrame, key: str | list[str], year: str, values: list[str]) -> DataFrame:
    """January anchors interpolated over multi-year gaps; months after the last anchor repeat it.

    Rural value and the proxy drivers are derived as in the yearly evaluation frame.
    """
    grid = cal.yearly_to_month_grid(yearly.select(*as_list(key), year, *values), key, year)
    return fill.interpolate(grid, key, "ts", values, edge="both")
