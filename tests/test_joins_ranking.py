import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import joins, ranking


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def asof_data(spark):
    """Requests with one hot series holding most rows, and unevenly spaced data."""
    rnd = random.Random(5)
    data = [(k, day(i), float(i)) for k in ("hot", "cold") for i in sorted(rnd.sample(range(20, 300), 25))]
    asked = [(n, "hot" if n % 10 else "cold", day(rnd.randrange(0, 320))) for n in range(800)] + [(900, "absent", day(3))]
    return (
        spark.createDataFrame(asked, "id int, k string, ts date"),
        spark.createDataFrame(data, "k string, ts date, v double"),
        asked,
        data,
    )


def test_asof_backward_matches_brute_force(asof_data):
    asked_df, data_df, asked, data = asof_data
    got = {r.id: (r.matched_ts, r.v) for r in joins.asof_backward(asked_df, data_df, "k", "ts", ["v"]).collect()}
    assert len(got) == len(asked)
    for n, k, ts in asked:
        rows = [(t, v) for kk, t, v in data if kk == k]
        before = [r for r in rows if r[0] <= ts]
        want = max(before) if before else (min(rows) if rows else (None, None))
        assert got[n] == want
    strict = joins.asof_backward(asked_df, data_df, "k", "ts", ["v"], else_first=False).where("id = 900").first()
    assert strict.v is None


def test_asof_nearest_matches_brute_force(asof_data):
    asked_df, data_df, asked, data = asof_data
    got = {r.id: (r.matched_ts, r.v) for r in joins.asof_nearest(asked_df, data_df, "k", "ts", ["v"]).collect()}
    for n, k, ts in asked:
        rows = [(abs((t - ts).days), t, v) for kk, t, v in data if kk == k]
        want = min(rows)[1:] if rows else (None, None)
        assert got[n] == want


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
@pytest.mark.parametrize("spread", [1, 600, 43_000])
def test_asof_at_any_precision(spark, kind, spread):
    """Times within a day, NULL times, equal data times, spans of up to 120 years, requests far outside: as brute force."""
    rnd = random.Random(spread)
    zero = dt.datetime(1900, 1, 1)

    def moment():
        t = zero + dt.timedelta(days=rnd.randrange(spread), microseconds=rnd.randrange(86_400_000_000))
        return t.date() if kind == "date" else t

    data = [(k, moment(), float(i)) for i, k in enumerate(["a"] * 40 + ["b"] * 3)] + [("a", None, -1.0), ("c", None, -2.0)]
    data += [(data[0][0], data[0][1], 99.0), (None, moment(), 5.0)]
    asked = [(n, rnd.choice(["a", "a", "a", "b", "c", "none", None]), rnd.choice([moment(), moment(), None, data[n % 40][1]])) for n in range(300)]
    far = dt.datetime(1700, 1, 1), dt.datetime(2400, 1, 1)
    asked += [(1000 + i, "a", t.date() if kind == "date" else t) for i, t in enumerate(far)]
    points = spark.createDataFrame(asked, f"id int, k string, ts {kind}")
    table = spark.createDataFrame(data, f"k string, ts {kind}, v double")
    best = {}
    for k, t, v in data:
        if t is not None and k is not None:
            best[k, t] = max(v, best.get((k, t), v))
    back = {r.id: (r.matched_ts, r.v) for r in joins.asof_backward(points, table, "k", "ts", ["v"]).collect()}
    strict = {r.id: (r.matched_ts, r.v) for r in joins.asof_backward(points, table, "k", "ts", ["v"], else_first=False).collect()}
    near = {r.id: (r.matched_ts, r.v) for r in joins.asof_nearest(points, table, "k", "ts", ["v"]).collect()}
    for n, k, t in asked:
        rows = sorted((u, v) for (kk, u), v in best.items() if kk == k) if t is not None else []
        before = [r for r in rows if r[0] <= t]
        assert strict[n] == (before[-1] if before else (None, None))
        assert back[n] == (before[-1] if before else rows[0] if rows else (None, None))
        assert near[n] == (min(rows, key=lambda r: (abs(r[0] - t), r[0])) if rows else (None, None))
    assert len(back) == len(asked)


def test_asof_dates_against_timestamps(spark):
    points = spark.createDataFrame([(1, "k", dt.date(2020, 1, 2)), (2, "k", dt.date(2020, 1, 1))], "id int, k string, ts date")
    data = spark.createDataFrame([("k", dt.datetime(2020, 1, 1, 9), 1.0), ("k", dt.datetime(2020, 1, 2, 1), 2.0)], "k string, ts timestamp, v double")
    assert {r.id: r.v for r in joins.asof_backward(points, data, "k", "ts", ["v"], else_first=False).collect()} == {1: 1.0, 2: None}
    assert {r.id: r.v for r in joins.asof_nearest(points, data, "k", "ts", ["v"]).collect()} == {1: 2.0, 2: 1.0}


def test_asof_joins_once(spark, asof_data):
    plan = joins.asof_nearest(asof_data[0], asof_data[1], "k", "ts", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_upsert_and_latest_source(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")
    assert {tuple(r) for r in joins.upsert(old, new, "k").collect()} == {("a", 1), ("b", 9), ("c", 3)}
    assert {tuple(r) for r in joins.latest_source_wins([old, new], "k").collect()} == {("a", 1), ("b", 9), ("c", 3)}


def test_latest_source_keeps_nulls_of_the_winning_row(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, v int, w string")
    new = spark.createDataFrame([("a", None, "y")], "k string, v int, w string")
    assert joins.latest_source_wins([old, new], "k").first() == ("a", None, "y")


def test_first_per_group_is_one_whole_row(spark):
    df = spark.createDataFrame([("g", 2, 5, "late"), ("g", 1, None, "early")], "g string, o int, v int, s string")
    assert ranking.first_per_group(df, "g", F.col("o")).first().asDict() == {"g": "g", "o": 1, "v": None, "s": "early"}


def test_last_row_by_number_hashes(spark):
    df = spark.createDataFrame([("g", 2, 5), ("g", 3, None), ("h", 1, 7), ("g", 3, None)], "g string, o long, v int")
    last = ranking.last_per_group(df, "g", F.col("o"))
    assert {tuple(r) for r in last.collect()} == {("g", 3, None), ("h", 1, 7)}
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_global_rank_with_hot_value(spark):
    rnd = random.Random(1)
    rows = [(i, 1.0 if rnd.random() < 0.4 else rnd.random()) for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, v double").repartition(7)
    got = {r.id: r.rank for r in ranking.global_rank(df, [F.col("v"), F.col("id")]).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in rows), start=1)}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_exact_median(spark, n):
    rnd = random.Random(n)
    vals = sorted(rnd.choice([1.0, 2.0, rnd.random()]) for _ in range(n))
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double")
    want = (vals[(n - 1) // 2] + vals[n // 2]) / 2
    assert ranking.exact_median(df, "v").first().median == want


def test_top_k(spark):
    df = spark.createDataFrame([("hot", i) for i in range(1000)] + [("cold", 1)], "g string, v int")
    got = ranking.top_k_per_group(df, "g", [F.desc("v")], 3)
    assert sorted((r.g, r.v, r["rank"]) for r in got.collect()) == [("cold", 1, 1), ("hot", 997, 3), ("hot", 998, 2), ("hot", 999, 1)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in ranking.top_k(df, [F.desc("v")], 2).collect()] == [999, 998]


def test_outer_chain_coalesces_key(spark):
    a = spark.createDataFrame([(1, 10)], "y int, a int")
    b = spark.createDataFrame([(2, 20)], "y int, b int")
    c = spark.createDataFrame([(2, 30), (3, 31)], "y int, c int")
    got = {tuple(r) for r in joins.join_chain(a, [b, c], "y", "full").collect()}
    assert got == {(1, 10, None, None), (2, None, 20, 30), (3, None, None, 31)}
