"""Seasonal ARIMA for all series and orders at once: by conditional sums of squares (``css``), or by two-stage least squares (Hannan and Rissanen, 1982).

A series is one row with its values as an array (bounded by the calendar). It is dealt once per differencing variant; a task fits all orders of
the variant on the same regressors, forecasts them together and, where the splits are known, scores them, so one row per (series, order)
leaves it. Two-stage least squares is linear: the solver works on the rows themselves, not on their cross products, and seasonal terms enter additively at the season lag; every order has an estimate. Conditional
sums of squares have multiplicative seasonal terms, and orders that do not converge to a stationary and invertible fit are marked so. Neither is maximum likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import numeric as nm
from seriesloom.operators import css
from seriesloom.operators.keys import as_list
from seriesloom.session import checkpointed, spread

# The search ranges of the seasonal grid and of the automatic order choice.
SEASONAL_GRID = {"p": (0, 1, 2), "d": (0, 1, 2), "q": (0, 1, 2), "sp": (0, 1), "sd": (0, 1), "sq": (0, 1), "season": 12}
AUTO_GRID = {"p": (0, 1, 2, 3, 4, 5), "d": (0, 1, 2), "q": (0, 1, 2, 3, 4, 5), "sp": (0,), "sd": (0,), "sq": (0,), "season": 1}


@dataclass(frozen=True)
class Grid:
    p: tuple[int, ...] = (1,)
    d: tuple[int, ...] = (1,)
    q: tuple[int, ...] = (1,)
    sp: tuple[int, ...] = (0,)
    sd: tuple[int, ...] = (0,)
    sq: tuple[int, ...] = (0,)
    season: int = 12
    long_lags: tuple[int, ...] = (1, 2, 3, 4)

    @property
    def seasonal(self) -> bool:
        return max(self.sp) > 0 or max(self.sq) > 0 or max(self.sd) > 0

    @property
    def w_lags(self) -> list[int]:
        return [*range(1, max(self.p) + 1), *([self.season] if max(self.sp) else [])]

    @property
    def e_lags(self) -> list[int]:
        return [*range(1, max(self.q) + 1), *([self.season] if max(self.sq) else [])]

    @property
    def long_ar(self) -> list[int]:
        return sorted({*self.long_lags, *([self.season] if self.seasonal else [])})

    def variants(self) -> list[dict]:
        """Differencing variants with the lag weights of (1-B)^d (1-B^m)^D (lag 0 left out)."""
        out = []
        for d, sd in product(self.d, self.sd):
            poly = {0: 1.0}
            for shift in [1] * d + [self.season] * sd:
                poly = {
                    lag: poly.get(lag, 0.0) - poly.get(lag - shift, 0.0) for lag in {*poly, *[x + shift for x in poly]}
                }
            out.append({"d": d, "sd": sd, "weights": {k: v for k, v in poly.items() if k}})
        return out

    def orders(self) -> list[dict]:
        """Order combinations with the positions of their regressors (0 is the constant)."""
        out = []
        for p, q, sp, sq in product(self.p, self.q, self.sp, self.sq):
            w = [lag for lag in self.w_lags if lag <= p or (sp and lag == self.season)]
            e = [lag for lag in self.e_lags if lag <= q or (sq and lag == self.season)]
            cols = [1 + self.w_lags.index(x) for x in w] + [1 + len(self.w_lags) + self.e_lags.index(x) for x in e]
            out.append({"p": p, "q": q, "sp": sp, "sq": sq, "cols": cols})
        return out


def seasonal_grid() -> Grid:
    g = SEASONAL_GRID
    return Grid(g["p"], g["d"], g["q"], g["sp"], g["sd"], g["sq"], g["season"])


def auto_grid() -> Grid:
    g = AUTO_GRID
    return Grid(g["p"], g["d"], g["q"], g["sp"], g["sd"], g["sq"], g["season"], long_lags=(1, 2, 3, 4, 5, 6))


ORDER = ["p", "d", "q", "sp", "sd", "sq"]
SPLITS = ("TRAIN", "VAL", "TEST")
SCORES = [f"{s.lower()}_{m}" for s in SPLITS for m in ("rmse", "mae", "mape")]


def _lagged(values: np.ndarray, lag: int) -> np.ndarray:
    out = np.full(len(values), np.nan)
    out[lag:] = values[:-lag]
    return out


def _depth(grid: Grid) -> int:
    """Number of past steps a forecast looks back."""
    return max([lag for v in grid.variants() for lag in v["weights"]] + grid.w_lags + grid.e_lags + [1])


def _warm_up(grid: Grid, variant: dict) -> int:
    """Rows before the first one whose regressors can all be there."""
    back = max([0, *variant["weights"]])
    errors = max(grid.long_ar) + max(grid.e_lags) if grid.e_lags else 0
    return back + max([0, errors, *grid.w_lags])


def _newest(values: np.ndarray, end: int, depth: int) -> np.ndarray:
    """Values before ``end``, newest first, zero where there are none."""
    found = np.zeros(depth)
    some = values[max(0, end - depth) : end][::-1]
    found[: len(some)] = np.nan_to_num(some, nan=0.0)
    return found


def fit_variant(y: np.ndarray, train_n: int, grid: Grid, variant: dict, extra: int = 0, common: bool = False) -> list[dict]:
    """All orders of one differencing variant for one series.

    ``y`` holds the series, NaN where a value is missing; the first ``train_n`` rows are learned from. ``predicted`` has one-step fitted values
    in the train part (NaN while warming up), the forecast path after it, and ``extra`` steps beyond the series. With ``common``
    all variants learn from the same rows, so that their AIC can be compared.
    """
    n = len(y)
    weights = variant["weights"]
    w = y.copy()
    for lag, weight in weights.items():
        w = w + weight * _lagged(y, lag)
    train = np.arange(n) < train_n
    long = np.column_stack([np.ones(n), *(_lagged(w, lag) for lag in grid.long_ar)])
    first = train & np.isfinite(long).all(axis=1) & np.isfinite(w)
    e = np.full(n, np.nan)
    if first.any():
        e = w - long @ np.linalg.lstsq(long[first], w[first], rcond=None)[0]
    x = np.column_stack([np.ones(n), *(_lagged(w, lag) for lag in grid.w_lags), *(_lagged(e, lag) for lag in grid.e_lags)])
    complete = np.isfinite(x).all(axis=1) & np.isfinite(w)
    used = train & complete
    if common:
        used &= np.arange(n) >= max(_warm_up(grid, v) for v in grid.variants())
    n_used, found, orders = int(used.sum()), [], grid.orders()
    coefs = np.zeros((len(orders), x.shape[1]))
    for i, order in enumerate(orders):
        cols = order["cols"] if weights else [0, *order["cols"]]
        k = order["p"] + variant["d"] + order["q"] + order["sp"] + variant["sd"] + order["sq"] + 1
        row = {**{c: order[c] for c in ("p", "q", "sp", "sq")}, "d": variant["d"], "sd": variant["sd"], "n": n_used, "status": "failed", "aic": None, "aicc": None, "beta": None, "predicted": None}
        if n_used > len(cols) + 1:
            if cols:
                coefs[i, cols] = np.linalg.lstsq(x[np.ix_(used, cols)], w[used], rcond=None)[0]
            sse = float(((w[used] - x[used] @ coefs[i]) ** 2).sum())
            aic = n_used * np.log(sse / n_used) + 2 * k if sse > 0 else -np.inf
            room = n_used - k - 1
            row |= {"status": "ok", "aic": aic, "aicc": aic + 2 * k * (k + 1) / room if room > 0 else None, "beta": coefs[i]}
        found.append(row)
    ahead = _paths(coefs, grid, weights, y, w, e, train_n, n - train_n + extra)
    with np.errstate(all="ignore"):
        fitted = (y - w)[None] + np.nan_to_num(coefs @ np.where(complete, x.T, np.nan), nan=np.nan, posinf=np.nan, neginf=np.nan)
    for i, row in enumerate(found):
        if row["status"] == "ok":
            row["predicted"] = np.concatenate([np.where(complete, fitted[i], np.nan)[:train_n], ahead[i]])
    return found


def _paths(coefs: np.ndarray, grid: Grid, weights: dict, y: np.ndarray, w: np.ndarray, e: np.ndarray, end: int, steps: int) -> np.ndarray:
    """Forecasts of several orders: the next differenced value from the regression (future shocks are zero), then the differencing undone."""
    depth, m = _depth(grid), len(coefs)
    back = np.array([weights.get(lag, 0.0) for lag in range(1, depth + 1)])
    ys, ws, es = (np.tile(_newest(v, end, depth), (m, 1)) for v in (y, w, e))
    w_at, e_at = [lag - 1 for lag in grid.w_lags], [lag - 1 for lag in grid.e_lags]
    split = 1 + len(w_at)
    out = np.empty((m, steps))
    with np.errstate(all="ignore"):
        for t in range(steps):
            new_w = coefs[:, 0] + (coefs[:, 1:split] * ws[:, w_at]).sum(axis=1) + (coefs[:, split:] * es[:, e_at]).sum(axis=1)
            out[:, t] = new_w - ys @ back
            for past, new in ((ys, out[:, t]), (ws, new_w), (es, 0.0)):
                past[:, 1:] = past[:, :-1].copy()
                past[:, 0] = new
    return out


def split_scores(y: np.ndarray, predicted: np.ndarray, splits: list[str]) -> dict[str, float | None]:
    """Train, validation and test errors, as ``metrics.split_bundle`` defines them."""
    labels, scores = np.array(splits), {}
    with np.errstate(all="ignore"):
        for name in SPLITS:
            here = (labels == name) & ~np.isnan(predicted[: len(y)]) & ~np.isnan(y)
            err, actual = (y - predicted[: len(y)])[here], y[here]
            usable = np.isfinite(err) & (np.abs(err) <= nm.EXPLODED_ERROR)
            relative = np.abs(err[actual != 0] / actual[actual != 0])
            low = name.lower()
            scores[f"{low}_rmse"] = None if not here.any() else float(np.sqrt((err**2).mean())) if usable.all() else float("inf")
            scores[f"{low}_mae"] = float(np.abs(err).mean()) if here.any() else None
            scores[f"{low}_mape"] = float(relative.mean() * 100) if len(relative) else None
    return scores


def fit_grid(df: DataFrame, key: str | list[str], ts: str, y: str, train: Column, grid: Grid, extra: int = 0, common: bool = False, split: str | None = None, method: str = "two_stage") -> DataFrame:
    """One row per (series, order): coefficients, AIC, AICc, status, ``train_n`` and the array ``predicted``, which covers all rows of the series and
    ``extra`` steps more. With ``split``, the name of a column of TRAIN, VAL and TEST, also the errors of each part. ``method`` is "two_stage" or "css"."""
    key = as_list(key)
    one_variant = {"two_stage": fit_variant, "css": css.fit_variant}[method]
    label = F.col(split) if split else F.lit(None).cast("string")
    item = F.struct(F.col(ts).alias("at"), F.col(y).cast("double").alias("y"), F.coalesce(train, F.lit(False)).alias("train"), label.alias("split"))
    packed = df.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("_rows"))
    variants = grid.variants()
    dealt = packed.select(
        *key, F.transform("_rows", lambda r: r["y"]).alias("_y"), F.size(F.filter("_rows", lambda r: r["train"])).alias("_train_n"),
        F.transform("_rows", lambda r: r["split"]).alias("_split"), F.explode(F.sequence(F.lit(0), F.lit(len(variants) - 1))).alias("_variant"),
    )
    scores = SCORES if split else []
    text = ", ".join([*(f"{c} int" for c in ORDER), "n long, status string, aic double, aicc double, beta array<double>, predicted array<double>, train_n int", *(f"{c} double" for c in scores)])
    schema = T.StructType([*[df.schema[k] for k in key], *T._parse_datatype_string(text).fields])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i in range(batch.num_rows):
                values = np.array(batch.column("_y")[i].as_py(), dtype=float)
                train_n = batch.column("_train_n")[i].as_py()
                labels = batch.column("_split")[i].as_py()
                for row in one_variant(values, train_n, grid, variants[batch.column("_variant")[i].as_py()], extra, common):
                    row["train_n"] = train_n
                    if split and row["predicted"] is not None:
                        row |= split_scores(values, row["predicted"], labels)
                    at.append(i)
                    rows.append(row)
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in key]
            rest = [pa.array([r.get(c) for r in rows], to_arrow(schema[c].dataType)) for c in schema.names[len(key) :]]
            yield pa.RecordBatch.from_arrays([*own, *rest], names=schema.names)

    return checkpointed(spread(dealt, *key, "_variant").mapInArrow(fit, schema))


def one_step(grid: Grid):
    """Column function: the value after an array of values, by the grid's single order fitted on all of them."""
    if len(grid.variants()) != 1 or len(grid.orders()) != 1:
        raise ValueError("one order only")

    @F.pandas_udf(T.DoubleType())
    def ahead(values: pd.Series) -> pd.Series:
        found = []
        for v in values:
            y = np.asarray(v, dtype=float)
            fit = fit_variant(y, len(y), grid, grid.variants()[0], extra=1)[0]
            found.append(fit["predicted"][-1] if fit["status"] == "ok" else None)
        return pd.Series(found, dtype=float)

    return ahead


def to_arrow(kind: T.DataType) -> pa.DataType:
    plain = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}
    return pa.list_(pa.float64()) if isinstance(kind, T.ArrayType) else plain[kind]


def predictions(fits: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, order, rn, predicted) of every row that has a prediction."""
    opened = fits.where(F.col("status") == "ok").select(*as_list(key), *ORDER, "train_n", F.posexplode("predicted").alias("_at", "predicted"))
    return opened.where(~F.isnan("predicted")).select(*as_list(key), *ORDER, "train_n", (F.col("_at") + 1).cast("int").alias("rn"), "predicted")


def pick_by_aic(fits: DataFrame, key: str | list[str]) -> DataFrame:
    """Order with the least AIC per series; smaller orders win ties."""
    rest = [c for c in fits.columns if c not in as_list(key)]
    order = F.struct("aic", "p", "d", "q", "sp", "sd", "sq")
    ok = fits.where((F.col("status") == "ok") & F.col("aic").isNotNull())
    return ok.groupBy(*as_list(key)).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*as_list(key), "_r.*")
