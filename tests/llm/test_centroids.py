import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import centroids


def plain(rows, count=8, rounds=10, dimensions=64):
    """[(id, cluster, distance)], inertia by cluster and the final centroids, in Python integers."""
    kept = [(k, v) for k, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    data = [(k, [math.floor(1024 * x) for x in v]) for k, v in kept]
    order = sorted(data, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:count]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in data]
        for j in range(len(now)):
            held = [v for (_, v), o in zip(data, own, strict=True) if o == j]
            if held:
                now[j] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    final = [(k, *reversed(nearest(v))) for k, v in data]
    sums = [sum(d for _, j, d in final if j == c) for c in range(len(now))]
    return final, sums, now


def compare(df, rows, **settings):
    got = [tuple(r) for r in centroids.clusters(df, **settings).collect()]
    final, sums, now = plain(rows, settings.get("centroids", 8), settings.get("rounds", 10), settings.get("dimensions", 64))
    want = [(k, j, d, sums[j], sum(sums), hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for k, j, d in final]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.fixture(scope="module")
def blobs():
    rnd = random.Random(3)
    middles = [[rnd.uniform(-1, 1) for _ in range(64)] for _ in range(8)]
    rows = [(i, [rnd.gauss(x, 0.2) for x in rnd.choice(middles)]) for i in range(260)]
    rows += [(1000 + i, rows[5][1]) for i in range(130)]  # a third of all rows are one vector
    return rows


def test_equals_plain_rounds(spark, blobs):
    df = spark.createDataFrame(blobs, "vec_id long, embedding array<double>").repartition(5)
    compare(df.withColumns({"id": F.lit(1), "cluster": F.lit(2), "distance": F.lit("x"), "vector": F.lit(0)}), blobs)


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_other_settings_and_ties(spark, rounds):
    rnd = random.Random(rounds)
    rows = [(i, [float(rnd.randrange(-3, 4)) / 512 for _ in range(3)]) for i in range(80)]  # few values: ties between centroids
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, centroids=5, rounds=rounds, dimensions=3)


def test_odd_rows(spark, blobs):
    rows = [*blobs[:30], blobs[3], blobs[3], (None, blobs[4][1]), (None, blobs[9][1]), (5000, None), (5001, []), (5002, [1.0] * 63), (5003, [1.0] * 63 + [None])]
    rows += [(5004, [1.0] * 63 + [math.nan]), (5005, [1.0] * 63 + [math.inf]), (5006, [-0.0] * 64), (-7, [1e-9] * 64), (2**62, [-1e-9] * 64), (5007, [1000.0] + [0.0] * 63)]
    compare(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows)


def test_fewer_vectors_than_centroids(spark, blobs):
    compare(spark.createDataFrame(blobs[:3], "vec_id long, embedding array<float>"), [(k, [float(np.float32(x)) for x in v]) for k, v in blobs[:3]])


def test_values_without_a_distance_are_named(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no squared distance"):
        centroids.clusters(df).collect()


def test_empty_table(spark):
    assert centroids.clusters(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_bounds_spare_distances_and_take_the_whole_displacement(blobs):
    vectors = np.array([[math.floor(1024 * x) for x in v] for _, v in blobs], np.int64)
    there = vectors[:8] + 40
    history = [vectors[:8], there, vectors[:8] + 1]  # far away and back: the sum of drifts would be large, the displacement is small
    exact = np.stack([centroids.squared(vectors, c) for c in history[0]], axis=1)
    own, distance, seen = exact.argmin(axis=1).astype(np.int32), np.sqrt(exact.astype(float)), np.zeros(exact.shape, np.int32)
    now, _, computed = centroids.Bounds(history).assign(vectors, own, distance, seen)
    assert now.tolist() == np.stack([centroids.squared(vectors, c) for c in history[-1]], axis=1).argmin(axis=1).tolist()
    assert computed < 0.5 * exact.size
