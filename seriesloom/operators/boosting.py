"""Second-order gradient boosting on histograms, for all settings at once, and its flattened ensembles.

Features are cut at their quantiles. Under squared error, rows of equal bins have the same prediction in every tree, so their number and the sums of their targets and squares are all that boosting needs. Spark
adds these up over all rows, map-side first, into cells; where more than ``MOST_CELLS`` cells differ, neighbouring bins are merged until they fit. One task per setting then grows its trees on
the cells, from gradient and row sums per (open node, feature, bin); no Spark job is needed per tree. The gradient is prediction minus target, the curvature 1. Sampling for a tree draws cells.

A fitted ensemble is a set of node arrays. It is scored in one Arrow pass, and forecast recursively in one: predictions are pushed into each series' ring of lags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.session import checkpointed

SEED = 42
BINS = 64
PATIENCE = 50
MOST_CELLS = 200_000
_NODE = "setting int, tree int, node int, feature int, threshold double, left int, right int, value double"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Setting:
    """How one ensemble is grown; ``feature_share`` of the features are open to each tree, ``row_share`` of the rows grow it."""

    rounds: int
    depth: int
    step: float
    row_share: float = 1.0
    feature_share: float = 1.0
    least_rows: int = 1
    leaf_penalty: float = 1.0


@dataclass(frozen=True)
class Ensemble:
    """Trees as arrays over all their nodes; ``roots`` has the first node of every tree, ``feature`` is -1 at leaves. Missing values go left."""

    features: tuple[str, ...]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    errors: tuple[float, ...] = field(default=())  # mean squared error on the watched rows after every grown tree, those not kept included

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions for rows of ``x``, columns in the order of ``features``."""
        x = np.where(np.isnan(x), -np.inf, x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                right = x[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, np.where(right, self.right[at], self.left[at]))
            out += self.value[at]
        return out


def cut_points(rows: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of every component of ``x``, at most ``bins`` - 1 each, from one aggregate."""
    ranks = [i / bins for i in range(1, bins)]
    given = [F.when(~F.isnan(F.col("x")[i]), F.col("x")[i]) for i in range(width)]
    row = rows.agg(*(F.percentile_approx(c, ranks, 10_000).alias(f"q{i}") for i, c in enumerate(given))).first()
    return [np.unique(np.array(q or [], dtype=float)) for q in row]


class _Tree:
    """A tree while it grows: nodes in the order of their opening, each row's node, and the open nodes of the present level."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]
        self.open = [0]

    def split(self, node: int, feature: int, at: int, left_value: float, right_value: float) -> tuple[int, int]:
        first = len(self.feature)
        for v in (left_value, right_value):
            for held, x in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, v)):
                held.append(x)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, first, first + 1
        return first, first + 1


def best_split(g: np.ndarray, n: np.ndarray, columns: np.ndarray, setting: Setting) -> tuple[int, int] | None:
    """(feature, last bin that goes left) with the largest gain over per-bin gradient sums and row counts of a node; the first one at a tie, None without a gain."""
    left_g, left_n = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
    all_g, all_n = g.sum(axis=1)[:, None], n.sum(axis=1)[:, None]
    right_g, right_n = all_g - left_g, all_n - left_n
    p = setting.leaf_penalty

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a * a, b + p, out=np.zeros(np.broadcast(a, b).shape), where=b + p > 0)

    gain = score(left_g, left_n) + score(right_g, right_n) - score(all_g, all_n)
    gain[(left_n < setting.least_rows) | (right_n < setting.least_rows)] = -np.inf
    gain[~columns] = -np.inf
    if not gain.size:
        return None
    at = int(np.argmax(np.round(gain, 9)))
    feature, place = divmod(at, gain.shape[1])
    return (feature, place) if gain[feature, place] > 1e-9 else None


def _drawn(ids: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows (or columns) drawn in a round: a hash of their number against the share."""
    if share >= 1:
        return np.ones(len(ids), bool)
    h = (ids ^ np.uint64(seed * 2_654_435_761 % (1 << 64))) * _MIX
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53) < share


def grow(x: np.ndarray, n: np.ndarray, y: np.ndarray, yy: np.ndarray, watched: np.ndarray, bins: int, base: float, setting: Setting, patience: int | None, seed: int = SEED) -> tuple[list[_Tree], list[float]]:
    """(trees, errors on the watched cells after each) of one setting.

    ``x`` holds the cells' bin numbers, ``n`` their rows, ``y`` and ``yy`` the sums of targets and squares. ``watched`` cells grow no trees: with ``patience``, growing ends when so many
    trees in a row did not lower their error, and the trees up to the lowest remain.
    """
    width = x.shape[1]
    predicted = np.full(len(n), base)
    trees: list[_Tree] = []
    errors: list[float] = []
    seen = n[watched].sum()
    places = (np.arange(width) * bins)[None] + x
    ids = np.zeros(len(n), np.uint64)
    for f in range(width):
        ids = (ids ^ x[:, f].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(1)
    while len(trees) < setting.rounds:
        number = len(trees)
        columns = _drawn(np.arange(1, width + 1, dtype=np.uint64), seed + 7919 * number, setting.feature_share)
        tree = _Tree(columns if columns.any() else np.ones(width, bool))
        used = np.flatnonzero(~watched & _drawn(ids, seed + 104_729 * number, setting.row_share))
        gradient = n * predicted - y
        node_of = np.zeros(len(n), np.int64)
        for _ in range(setting.depth):
            opened = []
            for node in tree.open:
                at = used[node_of[used] == node]
                flat = places[at].ravel()
                g = np.bincount(flat, np.repeat(gradient[at], width), width * bins).reshape(width, bins)
                rows = np.bincount(flat, np.repeat(n[at], width), width * bins).reshape(width, bins)
                split = best_split(g, rows, tree.columns, setting)
                if split is None:
                    continue
                f, cut = split
                left_g, left_n, all_g, all_n = g[f, : cut + 1].sum(), rows[f, : cut + 1].sum(), g[f].sum(), rows[f].sum()
                weight = [-setting.step * a / (b + setting.leaf_penalty) for a, b in ((left_g, left_n), (all_g - left_g, all_n - left_n))]
                left, right = tree.split(node, f, cut, *weight)
                here = node_of == node
                node_of[here] = np.where(x[here, f] > cut, right, left)
                opened += [left, right]
            tree.open = opened
        trees.append(tree)
        predicted += np.array(tree.value)[node_of]
        if patience and seen:
            p = predicted[watched]
            errors.append(float((n[watched] * p * p - 2 * p * y[watched] + yy[watched]).sum() / seen))
            best = int(np.argmin(errors))
            if len(errors) - 1 - best >= patience:
                break
    return (trees[: int(np.argmin(errors)) + 1] if errors else trees), errors


CELL = "cell binary, w boolean, n double, y double, yy double"


def _added(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell", "w").agg(*(F.sum(c).alias(c) for c in ("n", "y", "yy")))


def binned_cells(rows: DataFrame, cuts: list[np.ndarray], most: int = MOST_CELLS) -> tuple[DataFrame, int]:
    """(cell, w, n, y, yy) over rows (x, y, w), and how often neighbouring bins were merged so that at most ``most`` cells remain. Bins are one byte per feature."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                bins = np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], side="left")) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                y = batch.column("y").to_numpy()
                yield pa.record_batch([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column("w"), pa.array(np.ones(len(y))), pa.array(y), pa.array(y * y)], names=["cell", "w", "n", "y", "yy"])

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coarse = [(np.frombuffer(c, np.uint8) >> 1).tobytes() for c in batch.column("cell").to_pylist()]
            yield pa.record_batch([pa.array(coarse, pa.binary()), *(batch.column(c) for c in ("w", "n", "y", "yy"))], names=["cell", "w", "n", "y", "yy"])

    cells, merged = checkpointed(_added(rows.mapInArrow(cut, CELL))), 0
    while cells.count() > most:
        cells, merged = checkpointed(_added(cells.mapInArrow(halved, CELL))), merged + 1
    return cells, merged


def fit(df: DataFrame, features: list[str], target: str, settings: list[Setting], watched: str | None = None, patience: int | None = PATIENCE, bins: int = BINS, most_cells: int = MOST_CELLS) -> list[Ensemble]:
    """One ensemble per setting, all from one pass over the rows.

    ``watched`` names a boolean column: its true rows grow no trees but say when to stop (``patience``) and how many trees stay. Rows without a target are left out.
    """
    x = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features]
    flag = F.coalesce(F.col(watched), F.lit(False)) if watched else F.lit(False)
    rows = checkpointed(df.where(F.col(target).isNotNull()).select(F.array(*x).alias("x"), F.col(target).cast("double").alias("y"), flag.alias("w")))
    train = rows.where("NOT w")
    cuts = cut_points(train, len(features), bins)
    cells, merged = binned_cells(rows, cuts, most_cells)
    step = 1 << merged
    coarse = [c[step - 1 :: step] for c in cuts]  # a merged bin ends where its last one did
    table = cells.orderBy("w", "cell").toArrow()  # at most ``most_cells`` rows
    if not table.num_rows or all(table["w"].to_pylist()):
        raise ValueError("no rows to grow trees from")
    grid = np.stack([np.frombuffer(c, np.uint8) for c in table["cell"].to_pylist()]).astype(np.int64)
    w, n, y, yy = (table[c].to_numpy() for c in ("w", "n", "y", "yy"))
    w = w.astype(bool)
    base = float(y[~w].sum() / n[~w].sum())
    widest = int(grid.max()) + 1
    settings = list(settings)
    spark = df.sparkSession
    held = spark.sparkContext.broadcast((grid, n, y, yy, w))

    def grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _NODE.split(", ")]
        kinds = [pa.int32()] * 4 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64()]
        for batch in batches:
            for s in batch.column("id").to_pylist():
                cells_x, cells_n, cells_y, cells_yy, cells_w = held.value
                trees, errors = grow(cells_x, cells_n, cells_y, cells_yy, cells_w, widest, base, settings[s], patience if watched else None)
                found = [*_rows_of(s, trees, coarse), *((s, -1, t, -1, e, 0, 0, 0.0) for t, e in enumerate(errors))]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    found = spark.range(0, len(settings), 1, len(settings)).mapInArrow(grow_trees, _NODE).toPandas()
    held.destroy()
    return [_ensemble(found[found["setting"] == s], tuple(features), base, settings[s].depth) for s in range(len(settings))]


def _rows_of(setting: int, trees: list[_Tree], cuts: list[np.ndarray]) -> Iterator[tuple]:
    for t, tree in enumerate(trees):
        for node, f in enumerate(tree.feature):
            yield setting, t, node, f, float(cuts[f][tree.bin[node]]) if f >= 0 else 0.0, tree.left[node], tree.right[node], float(tree.value[node])


def _ensemble(rows: pd.DataFrame, features: tuple[str, ...], base: float, depth: int) -> Ensemble:
    nodes, watched = rows[rows["tree"] >= 0].sort_values(["tree", "node"]), rows[rows["tree"] < 0].sort_values("node")
    first = nodes.groupby("tree").size().cumsum().shift(fill_value=0)
    offset = nodes["tree"].map(first).to_numpy()
    return Ensemble(
        features, float(base), nodes["feature"].to_numpy(), nodes["threshold"].to_numpy(), (nodes["left"].to_numpy() + offset), (nodes["right"].to_numpy() + offset),
        nodes["value"].to_numpy(), first.to_numpy(), depth, tuple(watched["threshold"]),
    )


def scored(df: DataFrame, ensemble: Ensemble, name: str = "predicted") -> DataFrame:
    """``df`` with the ensemble's predictions, in one Arrow pass; a column called ``name`` is replaced."""
    own = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in own), T.StructField(name, T.DoubleType())])
    inputs = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in ensemble.features))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(ensemble.features))
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(ensemble.predict(x))], names=[*own, name])

    return df.select(*own, inputs.alias("_x")).mapInArrow(run, schema)


def recursive_forecast(ensemble: Ensemble, state: DataFrame, lags: dict[str, int], known: dict[str, Callable[[Column], Column]], steps: int, time: Callable[[Column, Column], Column]) -> DataFrame:
    """``steps`` ahead for every series in one pass: (columns of ``state`` but ys and at, h, predicted).

    ``state`` has ``ys`` (newest last, as many as the longest lag) and the last time ``at``; ``time`` is the time ``h`` steps after it. ``lags`` maps features to their lag, ``known`` the others to a function of the time.
    """
    own = [c for c in state.columns if c not in ("ys", "at")]
    def over_time(f: Callable[[Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda h: f(time(F.col("at"), h)).cast("double"))

    ahead = [over_time(f) for f in known.values()]
    ready = state.select(*own, "ys", F.array(*ahead).alias("_known") if ahead else F.lit(None).cast("array<array<double>>").alias("_known"))
    schema = T.StructType([*(state.schema[c] for c in own), T.StructField("path", T.ArrayType(T.DoubleType()))])
    place = {n: i for i, n in enumerate(known)}
    longest = max(lags.values(), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ring = np.stack([np.asarray(v[-longest:], float) for v in batch.column("ys").to_pylist()]) if n else np.zeros((0, longest))
            given = batch.column("_known").flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, len(place), steps) if place else None
            path = np.zeros((n, steps))
            for h in range(steps):
                x = np.stack([ring[:, (h - lags[f]) % longest] if f in lags else given[:, place[f], h] for f in ensemble.features], axis=1)
                path[:, h] = ensemble.predict(x)
                ring[:, h % longest] = path[:, h]  # the oldest value gives way
            yield pa.record_batch([*(batch.column(c) for c in own), pa.array(list(path), pa.list_(pa.float64()))], names=[*own, "path"])

    out = ready.mapInArrow(run, schema)
    return out.select(*own, F.posexplode("path").alias("h", "predicted")).withColumn("h", F.col("h") + 1)

