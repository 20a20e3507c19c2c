"""Tables inside stored web pages, extracted with JVM regular expressions over whole pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import text as tx
from seriesloom.session import checkpointed

# Year bounds that tell a history table from a forecast table.
HISTORY_FROM = 1955
HISTORY_TO = (2025, 2030)
FORECAST_TO = 2040
MIN_YEARS = 3


# The character references that cell texts commonly hold; the ampersand itself comes last.
REFERENCES = {"&nbsp;": " ", "&#160;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&minus;": "−", "&amp;": "&"}


def decoded(text: Column) -> Column:
    """Text with its character references resolved."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), REFERENCES.items(), text)


def _block(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"


def extract_rows(
    pages: DataFrame, page_id: str, html: str, table: str = "table", row: str = "tr", cell: str = "t[dh]"
) -> DataFrame:
    """One row per table row of each page: ``page_id, table_id, row_no, cells``.

    ``table_id`` and ``row_no`` count from 0 within their page and table. Tags inside a cell
    are removed, character references resolved and blanks trimmed.
    """
    tables = pages.select(page_id, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_block(table)), 1)).alias("table_id", "_t"))
    rows = tables.select(
        page_id, "table_id", F.posexplode(F.regexp_extract_all("_t", F.lit(_block(row)), 1)).alias("row_no", "_r")
    )
    cells = F.regexp_extract_all("_r", F.lit(_block(cell)), 1)
    plain = F.transform(cells, lambda c: F.trim(decoded(F.regexp_replace(c, r"<[^>]*>", ""))))
    return rows.select(page_id, "table_id", "row_no", plain.alias("cells"))


def named_table(rows: DataFrame, headings: list[str]) -> DataFrame:
    """Body rows of one table under normalised headings."""
    names = [tx.clean_name(h) for h in headings]
    return rows.where(F.col("row_no") > 0).select(*[F.get("cells", i).alias(n) for i, n in enumerate(names)])


def headings_of(rows: DataFrame, page_id: str) -> DataFrame:
    """First row of each table as normalised headings."""
    return rows.where(F.col("row_no") == 0).select(
        page_id, "table_id", F.transform("cells", tx.clean_name_col).alias("headings")
    )


def year_tables(rows: DataFrame, page_id: str, year_heading: str = "Year", value_heading: str = "Population") -> DataFrame:
    """Text rows (page, table, year, value) of every table that has both headings, wherever the columns stand."""
    heads = headings_of(rows, page_id).withColumns(
        {"_y": F.array_position("headings", year_heading), "_v": F.array_position("headings", value_heading)}
    )
    usable = heads.where((F.col("_y") > 0) & (F.col("_v") > 0)).drop("headings")
    body = rows.where(F.col("row_no") > 0).join(usable, [page_id, "table_id"])
    return body.select(
        page_id,
        "table_id",
        F.get("cells", F.col("_y").cast("int") - 1).alias("year_text"),
        F.get("cells", F.col("_v").cast("int") - 1).alias("value_text"),
    )


def table_spans(tables: DataFrame, table_key: list[str], year_text: str, min_years: int = MIN_YEARS) -> DataFrame:
    """Year span of each candidate table; tables with too few numeric years are no candidates."""
    year = tx.to_number(F.col(year_text))
    return (
        tables.groupBy(*table_key)
        .agg(F.count(year).alias("n_years"), F.min(year).cast("int").alias("min_year"), F.max(year).cast("int").alias("max_year"))
        .where(F.col("n_years") >= min_years)
    )


def choose_tables(
    spans: DataFrame,
    table_key: list[str],
    history_from: int = HISTORY_FROM,
    history_to: tuple[int, int] = HISTORY_TO,
    forecast_to: int = FORECAST_TO,
) -> DataFrame:
    """The history and the forecast table among the candidates, as two tagged rows.

    History is the last candidate that starts early and ends around now, else the one that starts
    first (and ends last). Forecast is the last candidate that reaches far enough, else the first one that
    goes beyond the history table; it may be absent.
    """
    spans = checkpointed(spans)  # read three times below
    tag = F.struct(*table_key)
    is_history = (F.col("min_year") <= history_from) & F.col("max_year").between(*history_to)
    is_forecast = F.col("max_year") >= forecast_to
    picked = F.struct(tag.alias("t"), "min_year", "max_year")
    choice = spans.agg(
        F.max_by(F.when(is_history, picked), F.when(is_history, tag)).alias("_h"),
        F.min_by(picked, F.struct("min_year", (-F.col("max_year")).alias("m"), *table_key)).alias("_h2"),
        F.max_by(F.when(is_forecast, picked), F.when(is_forecast, tag)).alias("_f"),
    ).withColumn("_h", F.coalesce("_h", "_h2"))
    later = choice.select(F.col("_h.max_year").alias("v")).scalar()
    beyond = spans.where(F.col("max_year") > later).agg(F.min_by(picked, tag).alias("v")).scalar()
    both = choice.select(
        F.inline(
            F.array(
                F.struct(F.lit("history").alias("role"), F.col("_h").alias("_p")),
                F.struct(F.lit("forecast").alias("role"), F.coalesce("_f", beyond).alias("_p")),
            )
        )
    )
    return both.where(F.col("_p").isNotNull()).select("role", "_p.t.*", "_p.min_year", "_p.max_year")


def choose_tables_per_group(
    spans: DataFrame,
    group: list[str],
    table_key: list[str],
    history_from: int = HISTORY_FROM,
    history_to: tuple[int, int] = HISTORY_TO,
    forecast_to: int = FORECAST_TO,
) -> DataFrame:
    """:func:`choose_tables` within every group (a page, a site): ``group, role, table_key, min_year, max_year``.

    Two aggregates that are combined map-side and one join on the group; a group without a forecast table has one row.
    """
    tag = F.struct(*table_key)
    is_history = (F.col("min_year") <= history_from) & F.col("max_year").between(*history_to)
    picked = F.struct(tag.alias("t"), "min_year", "max_year")
    choice = spans.groupBy(*group).agg(
        F.max_by(F.when(is_history, picked), F.when(is_history, tag)).alias("_h1"),
        F.min_by(picked, F.struct("min_year", (-F.col("max_year")).alias("m"), *table_key)).alias("_h2"),
    ).select(*group, F.coalesce("_h1", "_h2").alias("_h"))
    is_forecast, beyond = F.col("max_year") >= forecast_to, F.col("max_year") > F.col("_h.max_year")
    both = spans.join(choice, group).groupBy(*group).agg(
        F.any_value("_h").alias("history"),
        F.coalesce(F.max_by(F.when(is_forecast, picked), F.when(is_forecast, tag)), F.min_by(F.when(beyond, picked), F.when(beyond, tag))).alias("forecast"),
    )
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("_p")) for r in ("history", "forecast")])
    return both.select(*group, F.inline(roles)).where(F.col("_p").isNotNull()).select(*group, "role", "_p.t.*", "_p.min_year", "_p.max_year")
