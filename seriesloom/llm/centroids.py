"""Centroid clustering with exact integer arithmetic and ns-bounds.

Vectors become integers floor(1024 x). The centroids start as the vectors with the smallest hashes of their ids; each round assigns every vector to the
nearest centroid (ties: smaller number) and replaces every non-empty one by the floor of its vectors' mean.

Every vector keeps, for each centroid, the distance at the last evaluation and the round of it. The driver retains the history of the centroids (one small
matrix a round), so a stored distance is loosened by the norm of that centroid's total displacement since its evaluation, not by the summed drifts of the rounds between. Only
where these bounds fail to separate a centroid from the own one is the distance computed again, in integers. The state is written after rounds 0, 1, 3, 7, ... only: as displacements are taken from
the round of the evaluation, older state stays valid, and later rounds read it again. Rounds return sums per centroid and task; nothing is grouped by vectors, so copies of one vector are no hot
spot.

Vectors that are NULL, of another length, or hold NULL or non-finite components are left out. Rows with a NULL id take part but come last in the choice of the start; repeated rows are rows of their own,
equal ids are ordered by their components. Fewer vectors than centroids give as many centroids as vectors. Scaled components of 2^27 or more have no squared distance in a long: the job stops
with an error that says so. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm import common

SCALE = 1024
DIMENSIONS = 64
CENTROIDS = 8
ROUNDS = 10
SEED = "3"
MOST = 1 << 27
STATE = "id long, vector array<int>, own int, distance array<double>, seen array<int>"


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for vectors of the right length whose components are all given and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def scaled(docs: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """(id, vector) with integer components."""

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.floor(scale * batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(found) and np.abs(found).max() >= MOST:
                raise ValueError(f"a component of {np.abs(found).max() / scale} has no squared distance in a long")
            yield pa.record_batch([batch.column("id"), _lists(found.astype(np.int32), dimensions)], names=["id", "vector"])

    rows = docs.where(usable(F.col(vector), dimensions)).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(floors, "id long, vector array<int>")


def _lists(flat: np.ndarray, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat))


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def first_centroids(rows: DataFrame, centroids: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """Vectors with the smallest hashes of their ids, in that order."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    found = rows.orderBy(hashed.asc_nulls_last(), "vector").limit(centroids).select("vector").collect()
    return np.array([r["vector"] for r in found], dtype=np.int64)


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Bounds:
    """Ns-bounds against the centroids of the latest of several rounds."""

    def __init__(self, history: list[np.ndarray]):
        self.now = history[-1]
        moved = np.stack([self.now - old for old in history]).astype(np.float64)
        self.moved = np.sqrt((moved * moved).sum(axis=2))  # (round of evaluation, centroid): norm of the total displacement since then
        self.round = len(history) - 1

    def assign(self, vectors: np.ndarray, own: np.ndarray, distance: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and exact squared distances where computed (else -1); ``distance`` and ``seen`` are brought up to date. The number of distances computed comes last."""
        n, k = distance.shape
        each = np.arange(n)
        exact = np.full((n, k), -1, np.int64)
        computed = 0

        def evaluate(pairs: np.ndarray) -> None:
            nonlocal computed
            for j in range(k):
                at = np.flatnonzero(pairs[:, j])
                if len(at):
                    exact[at, j] = squared(vectors[at], self.now[j])
                    distance[at, j] = np.sqrt(exact[at, j].astype(np.float64))
                    seen[at, j] = self.round
                    computed += len(at)

        loosened = self.moved[seen, np.arange(k)[None]]
        lower = distance - loosened
        lower -= 1e-9 * (1 + distance + loosened)  # rounding of the square roots must not separate what is equal
        upper = distance[each, own] + loosened[each, own]
        upper += 1e-9 * (1 + upper)
        rivals = lower <= upper[:, None]
        rivals[each, own] = False
        open_rows = rivals.any(axis=1)
        first = np.zeros((n, k), bool)
        first[each, own] = open_rows
        evaluate(first)  # the own distance first: it may rule the rivals out
        tight = np.where(open_rows, distance[each, own] * (1 + 1e-9) + 1e-9, upper)
        evaluate(rivals & (lower <= tight[:, None]))
        known = np.where(exact < 0, np.iinfo(np.int64).max, exact)
        nearest = np.where(open_rows, known.argmin(axis=1), own)  # argmin takes the smaller number at a tie
        return nearest.astype(np.int32), exact, computed


def _started(rows: DataFrame, first: np.ndarray) -> DataFrame:
    """State of round 0: all distances evaluated."""
    k = len(first)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"), batch.num_rows)
            exact = np.stack([squared(vectors, c) for c in first], axis=1)
            state = [pa.array(exact.argmin(axis=1).astype(np.int32)), _lists(np.sqrt(exact.astype(np.float64)).ravel(), k), _lists(np.zeros(exact.size, np.int32), k)]
            yield pa.record_batch([batch.column("id"), batch.column("vector"), *state], names=["id", "vector", "own", "distance", "seen"])

    return rows.mapInArrow(start, STATE)


def _state(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    vectors = _matrix(batch.column("vector"), n)
    return vectors, batch.column("own").to_numpy(), _matrix(batch.column("distance"), n).copy(), _matrix(batch.column("seen"), n).copy()


def _advanced(state: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The state with every vector assigned to the latest centroids."""
    k = len(history[-1])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            if batch.num_rows:
                vectors, own, distance, seen = _state(batch, k)
                own, _, _ = bounds.assign(vectors, own, distance, seen)
                found = [pa.array(own), _lists(distance.ravel(), k), _lists(seen.ravel(), k)]
                yield pa.record_batch([batch.column("id"), batch.column("vector"), *found], names=["id", "vector", "own", "distance", "seen"])

    return state.mapInArrow(step, STATE)


def _sums(state: DataFrame, history: list[np.ndarray], dimensions: int) -> tuple[np.ndarray, list[list[int]]]:
    """Number of vectors and componentwise sums by centroid, for the assignment to the latest centroids. Tasks return their own sums; sums of tasks add as decimals."""
    k = len(history[-1])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        count, total = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            if batch.num_rows:
                vectors, own, distance, seen = _state(batch, k)
                own, _, _ = bounds.assign(vectors, own, distance, seen)
                count += np.bincount(own, minlength=k)
                for j in range(k):
                    total[j] += vectors[own == j].sum(axis=0, dtype=np.int64)
        numbers = np.repeat(np.arange(k), dimensions)
        places = np.tile(np.arange(dimensions), k)
        yield pa.record_batch([pa.array(numbers), pa.array(places), pa.array(np.repeat(count, dimensions)), pa.array(total.ravel())], names=["j", "place", "n", "total"])

    added = state.mapInArrow(partial, "j long, place long, n long, total long").groupBy("j", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counts, sums = np.zeros(k, np.int64), [[0] * dimensions for _ in range(k)]
    for r in added.collect():  # centroids x dimensions rows
        counts[r["j"]] = r["n"]
        sums[r["j"]][r["place"]] = int(r["total"])
    return counts, sums


def fit(rows: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: str = SEED) -> tuple[DataFrame, list[np.ndarray]]:
    """State of the last written round and the history of the centroids, the final ones last."""
    first = first_centroids(rows, centroids, seed)
    if not len(first):
        return rows, []
    history = [first]
    state = common.stored(_started(rows, first), "state")
    written = 0
    for number in range(rounds):
        if number == 2 * written + 1:  # 1, 3, 7, ...
            state, written = common.stored(_advanced(state, history), "state"), number
        counts, sums = _sums(state, history, dimensions)
        now = history[-1].copy()
        for j in np.flatnonzero(counts):
            now[j] = [total // int(counts[j]) for total in sums[j]]
        history.append(now)
    return state, history


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def clusters(
    docs: DataFrame, key: str = "vec_id", vector: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector."""
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = common.stored(scaled(docs, key, vector, dimensions, scale), "vectors")
    state, history = fit(rows, centroids, rounds, dimensions, seed)
    if not history:
        return docs.sparkSession.createDataFrame([], schema)
    k = len(history[-1])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = Bounds(history)
        for batch in batches:
            if batch.num_rows:
                vectors, own, distance, seen = _state(batch, k)
                own, exact, _ = bounds.assign(vectors, own, distance, seen)
                found = exact[np.arange(len(own)), own]
                for j in range(k):
                    at = np.flatnonzero((found < 0) & (own == j))
                    found[at] = squared(vectors[at], history[-1][j])
                yield pa.record_batch([batch.column("id"), pa.array(own), pa.array(found)], names=["id", "cluster", "distance"])

    placed = common.stored(state.mapInArrow(last, "id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    whole = sum(sums.values())
    own = [F.when(F.col("cluster") == j, F.struct(F.lit(sums.get(j, 0)).cast("long").alias("i"), F.lit(digest(c)).alias("h"))) for j, c in enumerate(history[-1])]
    return placed.withColumn("of", reduce(lambda a, b: F.coalesce(a, b), own)).select(
        F.col("id").alias(key), "cluster", "distance", F.col("of.i").alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), F.col("of.h").alias("centroid_sha256")
    )


def _sql(centroids: int, rounds: int) -> str:
    parts = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range({DIMENSIONS})) AS i FROM kept),
c0 AS MATERIALIZED (SELECT j, unnest(v) AS c, unnest(range({DIMENSIONS})) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS j FROM kept QUALIFY j < {centroids}))"""
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT row, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT row, j, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY ALL) GROUP BY row)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT j, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r}
  LEFT JOIN (SELECT j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM x JOIN a{r} USING (row) GROUP BY ALL) USING (j, i))"""
            )
    return (
        ",\n".join(parts)
        + f"""
SELECT vec_id, j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
FROM kept JOIN a{rounds} USING (row) JOIN (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY j) USING (j)"""
    )


SQL = _sql(CENTROIDS, ROUNDS)
