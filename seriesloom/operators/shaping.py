"""Schema operators: they build a select list on the driver and never touch the data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions import text as tx


def keep_available(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def rename_positional(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.toDF(*names)


def clean_headings(df: DataFrame) -> DataFrame:
    return df.toDF(*[tx.clean_name(c) for c in df.columns])


def apply_aliases(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """For each target that is absent, copy the first alias that is present."""
    have = set(df.columns)
    extra = {}
    for target, options in aliases.items():
        found = next((o for o in options if o in have), None)
        if target not in have and found:
            extra[target] = F.col(found)
    return df.withColumns(extra) if extra else df


def require_numeric(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add each missing column as NULL and make every named column numeric."""
    have = set(df.columns)
    return df.withColumns(
        {c: tx.coerce(F.col(c)) if c in have else F.lit(None).cast("double") for c in names}
    )


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in df.columns else default


def reindex_columns(df: DataFrame, names: Iterable[str], fill: float = 0.0) -> DataFrame:
    return df.select(*[column_or(df, n, F.lit(fill)).alias(n) for n in names])


def insert_column(df: DataFrame, position: int, name: str, c: Column) -> DataFrame:
    cols = [F.col(x) for x in df.columns]
    cols.insert(position, c.alias(name))
    return df.select(*cols)


def exclude(df: DataFrame, target: str, leaking: Iterable[str]) -> list[str]:
    """Feature names: everything but the target and the columns that leak it."""
    out = {target, *leaking}
    return [c for c in df.columns if c not in out]


def one_hot(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.withColumns(
        {f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in values}
    ).drop(column)


def drop_incomplete(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def first_rows_text(df: DataFrame, order: str, rows: int) -> Column:
    """The first rows by ``order`` as text, cells joined by a bar and rows by a semicolon, as a scalar subquery; every task keeps only ``rows`` rows."""
    head = df.orderBy(order).limit(rows)
    line = F.struct(F.col(order).alias("o"), F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]).alias("t"))
    packed = F.transform(F.array_sort(F.collect_list(line)), lambda r: r["t"])
    return head.agg(F.array_join(packed, ";").alias("v")).scalar()


def profile(df: DataFrame, name: str, time_col: str | None = None, order: str | None = None, rows: int = 3) -> DataFrame:
    """One row per table: rows, columns, non-null cells, the first rows by ``order``, and the year range where there is a time column."""
    first = first_rows_text(df, order, rows) if order else F.lit(None).cast("string")
    year = F.year(time_col) if time_col else F.lit(None).cast("int")
    cells = sum((F.count(c) for c in df.columns), F.lit(0))
    return df.agg(
        F.lit(name).alias("table_name"),
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"),
        cells.cast("long").alias("filled_cells"),
        F.min(year).cast("long").alias("min_year"),
        F.max(year).cast("long").alias("max_year"),
    ).withColumn("first_rows", first)
