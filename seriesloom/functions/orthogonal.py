"""Least squares from orthogonal factors (tall-skinny QR).

Each task reduces its rows of a series to one small triangular factor, and factors are combined in a tree of two levels: first within
groups of tasks, then over the groups. No cross products are made, so columns that are nearly equal lose half as many digits.
With a leading column of ones the factor also holds the means and deviations, so rows are read once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Series whose factors a task holds at once; beyond it they are sent on and begun anew.
SERIES_AT_ONCE = 2048
# Groups of tasks whose factors of a series are combined first.
PARTS = 64


def reduced(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of some rows. Rows that are not more than their columns stay; with a value that is not finite one row of NaN is left."""
    if len(rows) <= rows.shape[1]:
        return rows
    return np.linalg.qr(rows, mode="r") if np.isfinite(rows).all() else np.full((1, rows.shape[1]), np.nan)


def factors(df: DataFrame, key: list[str], columns: list[Column]) -> DataFrame:
    """(key, _n rows, _factor) for every series: ``columns`` of all its rows as one factor, row by row. A NULL counts as NaN; ``key`` has one column or more."""
    width = len(columns)
    keys = [f"_k{i}" for i in range(len(key))]
    flat = df.select(*[F.col(k).alias(a) for k, a in zip(key, keys)], *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    schema = T.StructType(
        [*flat.schema.fields[: len(key)], T.StructField("_part", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("_factor", T.ArrayType(T.DoubleType()))]
    )

    def sent(held: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        ids = [pa.array([name[i] for name in held], kind) for i, kind in enumerate(kinds)]
        part = TaskContext.get().partitionId() % PARTS  # the same when the task is run again
        counts, lists = pa.array([n for n, _ in held.values()], pa.int64()), pa.array([f.ravel() for _, f in held.values()], pa.list_(pa.float64()))
        return pa.record_batch([*ids, pa.array([part] * len(held), pa.int32()), counts, lists], names=schema.names)

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        for batch in batches:
            kinds = [batch.column(i).type for i in range(len(keys))]
            values = np.column_stack([batch.column(len(keys) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)])
            ids = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))], strict=True))
            codes, names = pd.factorize(pd.Index(ids, tupleize_cols=False))
            blocks = np.split(values[np.argsort(codes, kind="stable")], np.cumsum(np.bincount(codes, minlength=len(names)))[:-1])
            for name, rows in zip(names, blocks, strict=len(names) > 0):
                if name not in held and len(held) >= SERIES_AT_ONCE:
                    yield sent(held, kinds)
                    held = {}
                n, before = held.get(name, (0, rows[:0]))
                held[name] = (n + len(rows), reduced(np.concatenate([before, rows])))
        if held:
            yield sent(held, kinds)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def combined(lists: pd.Series) -> pd.Series:
        return pd.Series([reduced(np.concatenate([np.asarray(f, dtype=float).reshape(-1, width) for f in fs])).ravel() for fs in lists], dtype=object)

    found = flat.mapInArrow(reduce_rows, schema)
    for group in ([*keys, "_part"], keys):
        sums = found.groupBy(*group).agg(F.sum("_n").alias("_n"), F.collect_list("_factor").alias("_l"))
        found = sums.select(*group, "_n", combined("_l").alias("_factor"))
    return found.select(*[F.col(a).alias(k) for a, k in zip(keys, key)], "_n", "_factor")


def _solution(factor: np.ndarray, n: int, ridge: float) -> tuple | None:
    """(beta, mu, sd, y_mean) from a factor of the columns 1, x..., y."""
    k = factor.shape[1] - 2
    if not n or not np.isfinite(factor).all():
        return None
    r = np.linalg.qr(np.vstack([factor, np.zeros((k + 2, k + 2))]), mode="r")
    means, centred = r[0, 1:] / r[0, 0], r[1:, 1:]
    sd = np.sqrt((centred[:, :k] ** 2).sum(axis=0) / n)
    flat = sd <= 8 * np.finfo(float).eps * np.abs(means[:k])
    sd[flat] = 1.0
    a, b = np.where(flat, 0.0, centred[:, :k] / sd), centred[:, k]
    if ridge:
        a, b = np.vstack([a, np.sqrt(ridge) * np.eye(k)]), np.append(b, np.zeros(k))
    return np.linalg.lstsq(a, b, rcond=None)[0], means[:k], sd, means[k]


def solved(found: DataFrame, key: list[str], k: int, ridge: float = 0.0) -> DataFrame:
    """(key, n, beta, mu, sd, y_mean): weights on standardised columns for factors of 1, k columns and y; all NULL where a value was not finite."""

    @F.pandas_udf("beta array<double>, mu array<double>, sd array<double>, y_mean double")
    def solve(lists: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [_solution(np.asarray(f, dtype=float).reshape(-1, k + 2), m, ridge) or (None,) * 4 for f, m in zip(lists, n)]
        out = pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(("beta", "mu", "sd"))})
        out["y_mean"] = pd.Series([np.nan if r[3] is None else r[3] for r in rows], dtype=float)
        return out

    return found.withColumn("_s", solve("_factor", "_n")).select(*key, F.col("_n").alias("n"), "_s.*")
