"""Panels built from the star-schema tables: members are nations or regions, values are order totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions import time as tm
from seriesloom.operators import calendar as cal
from seriesloom.operators import fill
from seriesloom.operators import features as ft
from seriesloom.operators.keys import one_value
from seriesloom.session import checkpointed

DRIVERS = ["birth_rate", "death_rate", "density", "rural", "urban"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A star-schema table."""
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def cents(c: str) -> Column:
    """A two-decimal amount as a whole number, so that sums are exact in any row order and stay in a long."""
    return F.rint(F.col(c) * 100).cast("long")


def money(c: str) -> Column:
    return F.sum(cents(c)) / F.lit(100.0)


def _bucket(unit: str):
    start = {"month": tm.month_start, "year": tm.year_start}[unit]
    return start(F.col("o_orderdate"))


def customer_members(spark: SparkSession, sf: str, level: str = "nation") -> DataFrame:
    """``c_custkey, member``: the nation or region name of every customer. Nations and regions are fixed small lists."""
    nations = table(spark, sf, "nation")
    if level == "region":
        regions = table(spark, sf, "region")
        named = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("member"))
    else:
        named = nations.select("n_nationkey", F.col("n_name").alias("member"))
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return customers.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "member")


def last_complete_year(spark: SparkSession, sf: str) -> Column:
    """The last year whose December holds an order, as a scalar subquery."""
    return one_value(table(spark, sf, "orders"), F.year(F.add_months(F.max("o_orderdate"), 1)) - 1)


def _orders_until(spark: SparkSession, sf: str, until: int | Column | None) -> DataFrame:
    """Orders up to the end of a year, by a range on their date that reaches the scan; all of them without a year."""
    orders = table(spark, sf, "orders")
    if until is None:
        return orders
    after = F.make_date((F.lit(until) if isinstance(until, int) else until) + 1, F.lit(1), F.lit(1))
    return orders.where(F.col("o_orderdate") < after.cast(orders.schema["o_orderdate"].dataType))


def member_cells(spark: SparkSession, sf: str, level: str = "nation", unit: str = "month", until: int | Column | None = None) -> DataFrame:
    """``member, ts, total``: one row per member and bucket that has orders.

    Orders are summed per customer and bucket before the customer join, so a customer holding a large part of
    all orders reaches that join as a handful of rows; the member sums are combined map-side again.
    """
    per_customer = (
        _orders_until(spark, sf, until)
        .select("o_custkey", _bucket(unit).alias("ts"), "o_totalprice")
        .groupBy("o_custkey", "ts")
        .agg(F.sum(cents("o_totalprice")).alias("amount"))
    )
    members = customer_members(spark, sf, level)
    return (
        per_customer.join(members, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("member", "ts")
        .agg((F.sum("amount") / F.lit(100.0)).alias("total"))
    )


def member_panel(spark: SparkSession, sf: str, level: str = "nation") -> DataFrame:
    """Member cells on the full monthly calendar; empty months are NULL."""
    return cal.regularise(member_cells(spark, sf, level), "member")


def fill_cells(cells: DataFrame) -> DataFrame:
    """Cells on the calendar with gaps interpolated and edges held."""
    return fill.interpolate(cal.regularise(cells, "member"), "member", "ts", ["total"], edge="both")


def filled_panel(spark: SparkSession, sf: str, level: str = "nation") -> DataFrame:
    return fill_cells(member_cells(spark, sf, level))


def total_of(cells: DataFrame, time: str = "ts") -> DataFrame:
    """Sum over members per time step, as the one-member series TOTAL, without reading the raw rows again."""
    return cells.groupBy(time).agg(money("total").alias("total")).select(F.lit("TOTAL").alias("member"), time, "total")


def panel_and_total(spark: SparkSession, sf: str, level: str = "nation") -> tuple[DataFrame, DataFrame]:
    """Filled member panel and the total series, both from one pass over the orders."""
    cells = checkpointed(member_cells(spark, sf, level))
    return fill_cells(cells), total_of(cells)


def members_and_total(spark: SparkSession, sf: str, level: str = "nation", until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Yearly members and yearly total, both from one pass over the orders."""
    yearly = checkpointed(yearly_members(spark, sf, level, until))
    return yearly, total_of(yearly, "year")


def national(spark: SparkSession, sf: str, unit: str = "month", until: int | Column | None = None) -> DataFrame:
    """Sum over all orders per bucket, as the one-member series TOTAL."""
    sums = (
        _orders_until(spark, sf, until)
        .groupBy(_bucket(unit).alias("ts"))
        .agg(money("o_totalprice").alias("total"))
    )
    return sums.select(F.lit("TOTAL").alias("member"), "ts", "total")


def drivers(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """Five driver series per bucket from the order lines."""
    start = {"month": tm.month_start, "year": tm.year_start}[unit]
    n = F.count(F.lit(1))
    returned = F.col("l_returnflag") == "R"
    price = cents("l_extendedprice")
    return (
        table(spark, sf, "lineitem")
        .groupBy(start(F.col("l_shipdate")).alias("ts"))
        .agg(
            (money("l_discount") / n).alias("birth_rate"),
            (money("l_tax") / n).alias("death_rate"),
            (money("l_quantity") / n).alias("density"),
            (F.sum(F.when(returned, price)) / F.lit(100.0)).alias("rural"),
            (F.sum(F.when(~returned, price)) / F.lit(100.0)).alias("urban"),
        )
    )


def yearly_members(spark: SparkSession, sf: str, level: str = "nation", until: int | None = None) -> DataFrame:
    """``member, year, total`` up to a year, by default the last complete one of the orders."""
    cells = member_cells(spark, sf, level, "year", last_complete_year(spark, sf) if until is None else until)
    return cells.select("member", F.year("ts").alias("year"), "total")


def yearly_national(spark: SparkSession, sf: str, until: int | None = None) -> DataFrame:
    rows = national(spark, sf, "year", last_complete_year(spark, sf) if until is None else until)
    return rows.select("member", F.year("ts").alias("year"), "total")


def yearly_drivers(spark: SparkSession, sf: str) -> DataFrame:
    rows = drivers(spark, sf, "year")
    return rows.select(F.year("ts").alias("year"), *DRIVERS)


def member_master(spark: SparkSession, sf: str, level: str = "nation") -> DataFrame:
    """Filled member panel joined with the total and the drivers, with shares and features.

    The total and the drivers have one row per month, so they are far below the broadcast limit
    however much data they were made from; Spark sees their real size at run time.
    """
    panel, total = panel_and_total(spark, sf, level)
    nat = total.select("ts", F.col("total").alias("national"))
    wide = panel.join(nat, "ts", "left").join(drivers(spark, sf), "ts", "left")
    wide = ft.proportion(wide, "total", "national")
    wide = ft.add_time_features(wide, "total", "member")
    return ft.lags(wide, "member", "ts", {"national_lag_1": ("national", 1), "national_lag_12": ("national", 12)})


def national_master(spark: SparkSession, sf: str) -> DataFrame:
    """Total series joined with the drivers, with features and driver lags; months without a full history dropped."""
    wide = national(spark, sf).join(drivers(spark, sf), "ts", "left")
    wide = ft.add_time_features(wide, "total", "member")
    return ft.driver_lags(wide, "member", "ts", DRIVERS).na.drop("any")
