"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def as_list(names: str | Iterable[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def series_window(key: str | Iterable[str], ts: str) -> WindowSpec:
    """The one window every series operator shares, so that a chain of them needs one exchange and one sort.

    A series holds at most one row per calendar step, so a partition is bounded by the
    calendar (a date column spans fewer than 120,000 months) however many raw rows it came from.
    """
    return Window.partitionBy(*as_list(key)).orderBy(ts)


def reverse_window(key: str | Iterable[str], ts: str) -> WindowSpec:
    return Window.partitionBy(*as_list(key)).orderBy(F.desc(ts))


def one_value(df: DataFrame, c: Column) -> Column:
    """A one-row aggregate of ``df`` as a scalar subquery: no join, no driver round trip."""
    return df.select(c.alias("v")).scalar()


def literal_rows(rows: list[dict], types: dict[str, str]) -> Column:
    """Fixed parameter rows as an array of structs: exploding it never needs a join."""

    def cell(value, kind):
        text = "'" + value.replace("'", "\\'") + "'" if isinstance(value, str) else repr(value)
        return f"CAST({text} AS {kind})"

    structs = (", ".join(f"'{n}', {cell(r[n], t)}" for n, t in types.items()) for r in rows)
    return F.expr("array(" + ", ".join(f"named_struct({x})" for x in structs) + ")")
