"""Filling gaps on an ordered series.

The value before a gap comes from an ascending running ``last``; the value after it from a
running ``last`` in descending order. Both are linear in the series length, unlike a frame
that starts at the current row and runs to the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.operators.keys import as_list, reverse_window, series_window


def _neighbours(df: DataFrame, key: list[str], ts: str, values: list[str]) -> DataFrame:
    up, down = series_window(key, ts), reverse_window(key, ts)
    df = df.withColumn("_pos", F.row_number().over(up))
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(v).alias("v"))) for v in values}
    df = df.withColumns({f"_prev_{v}": F.last(known[v], True).over(up) for v in values})
    return df.withColumns({f"_next_{v}": F.last(known[v], True).over(down) for v in values})


def _without_helpers(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("_prev_", "_next_"))], "_pos")


def _line(v: str, edge: str) -> Column:
    prev, nxt, pos = F.col(f"_prev_{v}"), F.col(f"_next_{v}"), F.col("_pos")
    inside = prev["v"] + (nxt["v"] - prev["v"]) * (pos - prev["p"]) / F.nullif(nxt["p"] - prev["p"], F.lit(0))
    leading = nxt["v"] if edge == "both" else F.lit(None).cast("double")
    return (
        F.when(F.col(v).isNotNull(), F.col(v))
        .when(prev.isNull(), leading)
        .when(nxt.isNull(), prev["v"])
        .otherwise(inside)
    )


def interpolate(df: DataFrame, key: str | list[str], ts: str, values: list[str], edge: str = "both") -> DataFrame:
    """Straight-line fill by row position. ``edge='both'`` also fills before the first value,
    ``edge='forward'`` leaves those rows NULL; after the last value it is repeated either way."""
    if edge not in ("both", "forward"):
        raise ValueError("edge must be 'both' or 'forward'")
    wide = _neighbours(df, as_list(key), ts, values)
    return _without_helpers(wide.withColumns({v: _line(v, edge) for v in values}))


def fill_both_ways(df: DataFrame, key: str | list[str], ts: str, values: list[str]) -> DataFrame:
    """Previous known value, else the next known one."""
    up, down = series_window(key, ts), reverse_window(key, ts)
    df = df.withColumns({f"_prev_{v}": F.last(v, True).over(up) for v in values})
    df = df.withColumns({v: F.coalesce(F.col(f"_prev_{v}"), F.last(v, True).over(down)) for v in values})
    return df.drop(*[f"_prev_{v}" for v in values])


def interpolate_quadratic(df: DataFrame, key: str | list[str], ts: str, value: str) -> DataFrame:
    """Parabola through three anchors: the two around the gap and the nearest further one.

    The local form of ``interpolate_spline``: it needs no solver. The third anchor is the one before the left anchor, or, at the start of
    the series, the one after the right anchor. With two anchors it is a straight line; rows
    outside the anchors stay NULL.
    """
    key = as_list(key)
    up, down = series_window(key, ts), reverse_window(key, ts)
    known = F.col(value).isNotNull()
    point = F.struct(F.col("_pos").cast("double").alias("p"), F.col(value).alias("v"))
    df = df.withColumn("_pos", F.row_number().over(up))
    # nearest anchor on each side, then the anchor beyond it
    df = df.withColumns(
        {"_a": F.last(F.when(known, point), True).over(up), "_b": F.last(F.when(known, point), True).over(down)}
    )
    before = F.last(F.when(known, point), True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(F.when(known, point), True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumns({"_ap": F.when(known, before), "_bn": F.when(known, after)})
    df = df.withColumns({"_a0": F.last("_ap", True).over(up), "_anext": F.last("_bn", True).over(down)})
    df = df.withColumn("_c", F.coalesce("_a0", "_anext"))
    x, a, b, c = F.col("_pos"), F.col("_a"), F.col("_b"), F.col("_c")

    def term(p, q, r):
        return p["v"] * (x - q["p"]) * (x - r["p"]) / F.nullif((p["p"] - q["p"]) * (p["p"] - r["p"]), F.lit(0.0))

    straight = a["v"] + (b["v"] - a["v"]) * (x - a["p"]) / F.nullif(b["p"] - a["p"], F.lit(0.0))
    curve = term(a, b, c) + term(b, a, c) + term(c, a, b)
    filled = (
        F.when(known, F.col(value))
        .when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(c.isNull(), straight)
        .otherwise(curve)
    )
    return df.withColumn(value, filled).drop("_pos", "_a", "_b", "_ap", "_bn", "_a0", "_anext", "_c")


def spline_knots(x: np.ndarray) -> np.ndarray:
    """Knots of the order-2 interpolating spline: the ends three times, between them the middles of all inner pairs of anchors."""
    inner = (x[1:-2] + x[2:-1]) / 2 if len(x) > 3 else np.empty(0)
    return np.concatenate([[x[0]] * 3, inner, [x[-1]] * 3])


def _basis(knots: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first index, values) of the three order-2 B-splines that are not zero at each place."""
    count = len(knots) - 3
    span = np.clip(np.searchsorted(knots, at, side="right") - 1, 2, count - 1)
    t0, t1, t2, t3 = (knots[span + k] for k in (-1, 0, 1, 2))

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros_like(a), where=b > 0)

    left, right = part(t2 - at, t2 - t1), part(at - t1, t2 - t1)  # the two order-1 splines of the span
    first = part(t2 - at, t2 - t0) * left
    last = part(at - t1, t3 - t1) * right
    return span - 2, np.stack([first, 1.0 - first - last, last], axis=1)


def spline_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, weights) of the order-2 spline through the anchors, by elimination inside the band.

    Every anchor touches three splines, and the matrix is totally positive, so rows need no exchange and the work is linear in the number of anchors.
    """
    knots = spline_knots(x)
    first, values = _basis(knots, x)
    n = len(x)
    band = np.zeros((n, 5))  # columns i - 2 ... i + 2
    for i in range(n):
        for k in range(3):
            band[i, first[i] + k - i + 2] = values[i, k]
    right = np.array(y, dtype=float)
    for i in range(n):
        for j in (i + 1, i + 2):
            if j < n and band[j, i - j + 2]:
                factor = band[j, i - j + 2] / band[i, 2]
                for c in range(i, min(i + 3, n)):
                    band[j, c - j + 2] -= factor * band[i, c - i + 2]
                right[j] -= factor * right[i]
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = sum(band[i, c - i + 2] * out[c] for c in range(i + 1, min(i + 3, n)))
        out[i] = (right[i] - rest) / band[i, 2]
    return knots, out


def spline_values(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The order-2 spline through the anchors at places between the first and last one, NaN elsewhere; two anchors make a line, one a point."""
    inside = (at >= x[0]) & (at <= x[-1]) if len(x) else np.zeros(len(at), bool)
    out = np.full(len(at), np.nan)
    if len(x) < 3:
        out[inside] = np.interp(at[inside], x, y) if len(x) else np.nan
        return out
    knots, weights = spline_weights(x, y)
    first, values = _basis(knots, at[inside])
    out[inside] = (values * weights[first[:, None] + np.arange(3)]).sum(axis=1)
    return out


def interpolate_spline(df: DataFrame, key: str | list[str], ts: str, value: str) -> DataFrame:
    """Fill by the order-2 spline through all known values of a series, by row position; rows outside them stay NULL.

    A series is one row of arrays, bounded by the calendar.
    """
    key = as_list(key)

    @F.pandas_udf("array<double>")
    def filled(series: pd.Series) -> pd.Series:
        out = []
        for v in series:
            y = np.array(v, dtype=float)
            known = np.flatnonzero(np.isfinite(y))
            made = spline_values(known.astype(float), y[known], np.arange(len(y), dtype=float))
            made[known] = y[known]
            out.append(made)
        return pd.Series(out)

    item = F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    packed = df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    made = packed.select(*key, F.inline(F.arrays_zip(F.col("_rows.t").alias("t"), filled(F.col("_rows.v")).alias("v")))).toDF(*key, ts, "_filled")
    joined = df.drop(value).join(made, [*key, ts], "left")
    return joined.withColumn(value, F.when(~F.isnan("_filled"), F.col("_filled"))).drop("_filled").select(*df.columns)
