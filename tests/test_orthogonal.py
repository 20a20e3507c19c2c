import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import orthogonal as ol
from seriesloom.operators import regression as rg

XS = [f"x{i}" for i in range(16)]


def table(spark, groups, parts=7):
    rows = [(k, *map(float, x), float(y)) for k, xs, ys in groups for x, y in zip(xs, ys)]
    order = np.random.default_rng(1).permutation(len(rows))
    width = len(rows[0]) - 2
    names = ", ".join(f"x{i} double" for i in range(width))
    return spark.createDataFrame([rows[i] for i in order], f"k string, {names}, y double").repartition(parts)


def near_lags(rnd, n, spread):
    """Sixteen columns that differ by small noise around one random walk."""
    walk = 1000 + np.cumsum(rnd.normal(0, 1, n))
    return walk[:, None] + spread * rnd.normal(0, 1, (n, 16))


def standard(x):
    return (x - x.mean(axis=0)) / x.std(axis=0)


def test_nearly_equal_columns_keep_their_digits(spark):
    rnd = np.random.default_rng(2)
    groups = []
    for k, n, spread in (("hot", 3000, 1e-5), ("cold", 60, 1e-4), ("far", 400, 1e-8)):
        x = near_lags(rnd, n, spread)
        groups.append((k, x, x @ rnd.normal(0, 1, 16) + rnd.normal(0, 1e-7, n)))
    fits = {r.k: r for r in rg.fit(table(spark, groups), "k", XS, "y", F.lit(True)).collect()}
    for k, x, y in groups:
        z, r = standard(x), fits[k]
        assert r.n == len(x) and r.status == "ok"
        assert np.allclose(r.mu, x.mean(axis=0), rtol=1e-12) and np.allclose(r.sd, x.std(axis=0), rtol=1e-6)
        assert r.y_mean == pytest.approx(y.mean(), rel=1e-12)
        wanted = np.linalg.lstsq(z, y - y.mean(), rcond=None)[0]
        if k != "far":  # condition below 1e8: the weights themselves
            assert np.abs(r.beta - wanted).max() <= 1e-5 * np.abs(wanted).max()
        best = np.linalg.norm(y - y.mean() - z @ wanted)
        assert np.linalg.norm(y - y.mean() - (x - np.array(r.mu)) / r.sd @ np.array(r.beta)) <= best * (1 + 1e-6) + 1e-9 * np.linalg.norm(y - y.mean())


def test_condition_of_1e10(spark):
    """A design of condition 1e10 after scaling; least squares through cross products has no digit left there."""
    rnd = np.random.default_rng(6)
    u = rnd.normal(0, 1, (500, 3))
    x = np.column_stack([u[:, 0], u[:, 0] + 2e-10 * u[:, 1], u[:, 2]])
    x -= x.mean(axis=0)
    assert 3e9 < np.linalg.cond(standard(x)) < 3e10
    y = standard(x) @ [2.0, -1.0, 0.5]
    r = rg.fit(table(spark, [("a", x, y)]), "k", XS[:3], "y", F.lit(True)).first()
    wanted = np.linalg.lstsq(standard(x), y, rcond=None)[0]
    assert np.abs(np.array(r.beta) - wanted).max() < 1e-4 and abs(r.beta[2] - 0.5) < 1e-9


def test_ridge_flat_and_odd_rows(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(5, 2, (50, 3))
    x[:, 1] = 0.1
    y = x @ [1.0, 2.0, -3.0] + rnd.normal(0, 0.1, 50)
    df = table(spark, [("a", x, y), ("b", x[:3], y[:3])])
    for weight in (0.0, 5.0):
        fits = {r.k: r for r in rg.fit(df, "k", XS[:3], "y", F.lit(True), weight).collect()}
        z = standard(x[:, [0, 2]])
        wanted = np.linalg.solve(z.T @ z + weight * np.eye(2), z.T @ (y - y.mean()))
        assert np.allclose([fits["a"].beta[0], fits["a"].beta[2]], wanted, rtol=1e-9) and fits["a"].beta[1] == 0 and fits["a"].sd[1] == 1
        assert fits["b"].status == "too few rows" and fits["b"].beta is None
    odd = df.where("k = 'a'").unionByName(df.limit(2).withColumn("y", F.lit(None).cast("double"))).unionByName(df.limit(1).withColumn("k", F.lit(None).cast("string")))
    assert [(r.k, r.n) for r in rg.fit(odd, "k", XS[:3], "y", F.lit(True)).collect()] == [("a", 50)]
    endless = df.withColumn("x0", F.when(F.col("k") == "a", F.lit(float("inf"))).otherwise(F.col("x0")))
    assert {r.k: r.beta for r in rg.fit(endless, "k", XS[:3], "y", F.lit(True)).collect()} == {"a": None, "b": None}
    assert rg.fit(df.where("false"), "k", XS[:3], "y", F.lit(True)).collect() == []


def test_many_series_in_a_task(spark):
    """More series than a task holds at once; keys of two columns."""
    count = ol.SERIES_AT_ONCE + 300
    df = spark.range(0, count * 6, 1, 2).select((F.col("id") % count).alias("a"), F.lit("z").alias("b"), (F.col("id") / count).cast("int").cast("double").alias("x"))
    df = df.withColumn("y", 2 * F.col("x") + F.col("a"))
    rows = rg.fit(df, ["a", "b"], ["x"], "y", F.lit(True)).select("a", "n", (F.col("beta")[0] / F.col("sd")[0]).alias("slope"), (F.col("y_mean") - 5).alias("a2")).collect()
    assert len(rows) == count and all(r.n == 6 and abs(r.slope - 2) < 1e-9 and abs(r.a2 - r.a) < 1e-6 for r in rows)
