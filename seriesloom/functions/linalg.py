"""Least squares from moment sums.

Spark aggregates the cross products (one small row per series); only the k-by-k solve of those
rows happens in numpy, a batch of series at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-10


def moment_sums(xs: list[Column], y: Column, rows: Column | None = None) -> list[Column]:
    """Aggregates ``gram`` (upper triangle, row by row), ``xty``, ``yty`` and ``n`` over the selected rows."""
    keep = (lambda c: F.when(rows, c)) if rows is not None else (lambda c: c)
    gram = [F.sum(keep(xs[i] * xs[j])) for i in range(len(xs)) for j in range(i, len(xs))]
    return [
        F.array(*gram).alias("gram"),
        F.array(*[F.sum(keep(x * y)) for x in xs]).alias("xty"),
        F.sum(keep(y * y)).alias("yty"),
        F.count(keep(y)).alias("n"),
    ]


def _solve_batch(grams: np.ndarray, xtys: np.ndarray, idx: np.ndarray, ridges: np.ndarray) -> np.ndarray:
    """Solve the same selection of columns for many rows at once."""
    n, k = xtys.shape
    full = np.zeros((n, k, k))
    upper = np.triu_indices(k)
    full[:, upper[0], upper[1]] = grams
    full[:, upper[1], upper[0]] = grams
    a, b = full[:, idx][:, :, idx], xtys[:, idx]
    # unit diagonal: columns of very different size stay solvable; flat columns get weight 0
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 0.0))
    scale[scale == 0] = 1.0
    a = a / (scale[:, :, None] * scale[:, None, :])
    a[:, np.arange(len(idx)), np.arange(len(idx))] += ridges[:, idx] / scale**2
    out = np.zeros((n, k))
    out[:, idx] = np.einsum("nij,nj->ni", np.linalg.pinv(a, rcond=_EPS, hermitian=True), b / scale) / scale
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_moments(gram: pd.Series, xty: pd.Series, cols: pd.Series, ridge: pd.Series) -> pd.Series:
    """Coefficients of the selected columns (others 0) for each row; sums with a NULL give NULL."""
    out: list[np.ndarray | None] = [None] * len(gram)
    batches: dict[tuple, list[int]] = {}
    for i, (g, b, c) in enumerate(zip(gram, xty, cols)):
        if g is not None and b is not None and np.isfinite(np.asarray([*g, *b], dtype=float)).all():
            batches.setdefault(tuple(c), []).append(i)
    for picked, rows in batches.items():
        g, b, r = (np.stack([np.asarray(s.iat[i], dtype=float) for i in rows]) for s in (gram, xty, ridge))
        solved = _solve_batch(g, b, np.asarray(picked, dtype=int), r) if picked else np.zeros_like(b)
        for i, beta in zip(rows, solved):
            out[i] = beta
    return pd.Series(out, dtype=object)


def solve(k: int, ridge: float = 0.0, unpenalised: int = 0, cols: Column | None = None) -> Column:
    """Solve the aggregated ``gram``/``xty`` of k columns; the first ``unpenalised`` ones carry no ridge."""
    weights = [0.0] * unpenalised + [float(ridge)] * (k - unpenalised)
    chosen = cols if cols is not None else F.array(*[F.lit(i) for i in range(k)])
    return solve_moments(F.col("gram"), F.col("xty"), chosen, F.array(*[F.lit(w) for w in weights]))


def dot(coefs: Column, xs: list[Column]) -> Column:
    return sum((F.get(coefs, i) * x for i, x in enumerate(xs)), F.lit(0.0))
