"""Calendar expressions. Dates carry no time of day, so none of these depend on the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Growing season by month (May to September, and the rest of the year).
SEASON_BY_MONTH = {
    "Yala": (5, 6, 7, 8, 9),
    "Maha": (10, 11, 12, 1, 2, 3, 4),
}

# Fixed value: mean days per month used to turn a day distance into months.
DAYS_PER_MONTH = 30.44


def month_start(ts: Column) -> Column:
    return F.to_date(F.trunc(ts, "MM"))


def year_start(ts: Column) -> Column:
    return F.to_date(F.trunc(ts, "YEAR"))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def parse_date(text: Column, fmt: str | None = None) -> Column:
    """Text to date; text that is no date becomes NULL."""
    return F.to_date(F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text))


def month_text(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))


def fractional_year(ts: Column) -> Column:
    return F.year(ts) + (F.month(ts) - 1) / F.lit(12.0)


def month_index(ts: Column) -> Column:
    """Months since year 0: the position of a month on the regular monthly grid."""
    return F.year(ts) * 12 + F.month(ts)


def month_steps(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)


def months_ahead(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(DAYS_PER_MONTH)


def first_month_after_year(last_year: Column) -> Column:
    """Dec-31 of the last observed year plus one month: forecasts start on the month grid after that date."""
    return F.add_months(year_end(last_year), 1)


def month_sin(ts: Column) -> Column:
    return F.sin(F.lit(2 * math.pi) * F.month(ts) / F.lit(12.0))


def month_cos(ts: Column) -> Column:
    return F.cos(F.lit(2 * math.pi) * F.month(ts) / F.lit(12.0))


def season(ts: Column, table: dict[str, tuple[int, ...]] = SEASON_BY_MONTH) -> Column:
    out = F.lit(None).cast("string")
    for name, months in reversed(list(table.items())):
        out = F.when(F.month(ts).isin(*months), F.lit(name)).otherwise(out)
    return out


def last_complete_year(override: int | None = None) -> Column:
    """Evaluation cutoff: last complete year, or a literal for reproducible runs."""
    return F.lit(override) if override is not None else F.year(F.current_date()) - 1
