"""From models to member forecasts, batch predictions, demand and serving lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.functions import time as tm
from seriesloom.operators.calendar import month_horizon
from seriesloom.operators.joins import keep_best
from seriesloom.operators.keys import as_list, literal_rows, one_value
from seriesloom.operators.trend import share_forecast
from seriesloom.session import checkpointed


def last_known(df: DataFrame, ts: str, values: list[str]) -> dict[str, Column]:
    """Each value of the newest row of a table, as scalar subqueries."""
    return {v: one_value(df, F.max_by(v, ts)) for v in values}


def ensemble(preds: DataFrame, by: list[str], value: str = "predicted") -> DataFrame:
    """Mean over the models that have a prediction; absent ones are skipped."""
    kept = F.when(nm.is_valid(F.col(value)), F.col(value))
    return preds.groupBy(*by).agg(F.avg(kept).alias("ensemble"), F.count(kept).alias("n_models"))


def allocate(
    coefs: DataFrame,
    key: str | list[str],
    national: DataFrame,
    start: str | Column | None = None,
    end: str | Column | None = None,
    months: int = 24,
    ts: str = "ts",
    total: str = "total",
    drivers: tuple[str, str] = ("density", "urban"),
    limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Monthly member forecast: predicted share times a grown total, by default for the ``months`` after the last total.

    The total grows simply from its last value; density stays at its last value and the urban part keeps its
    last share. Members without a model have no coefficient row and so no forecast.
    """
    key = as_list(key)
    density, urban = drivers
    national = checkpointed(national)  # one row per month, looked up four times
    last_ts = one_value(national, F.max(ts))
    last = last_known(national, ts, [total, density])
    urban_share = one_value(national, F.max_by(F.col(urban) / F.col(total), ts))
    first = F.add_months(F.trunc(last_ts, "month"), 1) if start is None else start
    grid = month_horizon(coefs, first, F.add_months(F.trunc(last_ts, "month"), months) if end is None else end)
    grid = grid.withColumn("national", nm.linear_growth(last[total], tm.months_ahead(F.col("ts"), last_ts)))
    grid = grid.withColumns({density: last[density], urban: urban_share * F.col("national")})
    scored = grid.withColumn("_share", F.col("intercept") + F.col("slope") * F.col("fractional_year"))
    out = share_forecast(scored, "_share", "national", limits)
    return out.select(
        "ts", *key, "year", "month",
        nm.half_even(F.col("predicted_proportion"), 6).alias("predicted_proportion"),
        "predicted_member", "national", density, urban,
    )


def predict_requests(
    requests: DataFrame, totals: dict[str, DataFrame], shares: DataFrame, member: str = "member", ts: str = "ts"
) -> DataFrame:
    """Predictions for a batch of (member, date) requests.

    ``totals`` maps a model name to its predicted total per date (``ts, predicted``); every model becomes a
    ``total_<name>`` column and their mean the ensemble. ``shares`` holds each member's line (``intercept``,
    ``slope``) on the fractional year; a member without one gets no share and no value.
    """
    tagged = [df.select(ts, F.lit(n).alias("model"), "predicted") for n, df in totals.items()]
    long = reduce(lambda a, b: a.unionByName(b), tagged)
    valid = F.when(nm.is_valid(F.col("predicted")), F.col("predicted"))
    wide = long.groupBy(ts).agg(
        *[F.max(F.when(F.col("model") == n, valid)).alias(f"total_{n}") for n in totals], F.avg(valid).alias("ensemble")
    )
    out = requests.join(wide, ts, "left").join(shares, member, "left")
    share = F.col("intercept") + F.col("slope") * tm.fractional_year(F.col(ts))
    return (
        out.withColumn("proportion", share)
        .withColumn("member_value", F.col("proportion") * F.col("ensemble"))
        .drop("intercept", "slope")
    )


def demand(forecast: DataFrame, value: str, rates: dict[str, float]) -> DataFrame:
    """Yearly demand of every item: value times its rate per head."""
    rows = [{"item": k, "rate": v} for k, v in rates.items()]
    table = F.inline(literal_rows(rows, {"item": "string", "rate": "double"}))
    return forecast.select("*", table).withColumn("demand", F.col(value) * F.col("rate"))


def compare_pipelines(parts: dict[str, DataFrame], on: list[str], value: str) -> DataFrame:
    """Pipelines side by side on the same (date, member), one aggregate instead of a join per pipeline."""
    tagged = [df.select(*on, F.lit(n).alias("pipeline"), F.col(value).alias("_v")) for n, df in parts.items()]
    merged = reduce(lambda a, b: a.unionByName(b), tagged)
    return merged.groupBy(*on).pivot("pipeline", list(parts)).agg(F.max("_v"))


# -- serving ---------------------------------------------------------------------------------------


def _by_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"year": F.year(ts), "month": F.month(ts)})


def lookup_national(requests: DataFrame, forecast: DataFrame, date: str, ts: str, value: str) -> DataFrame:
    """Forecast of the month of each requested date; a request without one is marked not found.

    Of several forecast rows in one month the first counts.
    """
    asked = _by_month(requests, date)
    monthly = _by_month(forecast, ts).select("year", "month", F.col(value).alias("predicted_value"), F.col(ts).alias("_ts"))
    table = keep_best(monthly, ["year", "month"], F.min_by, F.col("_ts")).drop("_ts")
    found = F.when(F.col("predicted_value").isNull(), "not_found").otherwise("found")
    return asked.join(table, ["year", "month"], "left").withColumn("status", found)


def lookup_member(
    requests: DataFrame, forecast: DataFrame, history: DataFrame, member: str, date: str, ts: str, value: str, past: str
) -> DataFrame:
    """Forecast value of (member, month), else the historical one, tagged by where it came from.

    Member names match without regard to case. Both sources are merged to one row per key first
    (the forecast wins), so the requests are joined once.
    """
    keys = ["_m", "year", "month"]

    def side(df, v, kind, prio):
        return _by_month(df, ts).select(
            F.lower(member).alias("_m"), "year", "month", F.col(member).alias("matched_member"),
            F.lit(kind).alias("value_type"), F.col(v).alias("predicted_value"), F.struct(F.lit(prio), ts).alias("_prio"),
        )

    both = side(forecast, value, "forecast", 0).unionByName(side(history, past, "historical_actual", 1))
    table = keep_best(both, keys, F.min_by, F.col("_prio")).drop("_prio")
    asked = _by_month(requests, date).withColumn("_m", F.lower(member))
    out = asked.join(table, keys, "left").drop("_m")
    return out.withColumn("status", F.when(F.col("predicted_value").isNull(), "not_found").otherwise("found"))
