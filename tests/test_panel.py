import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import fill, shaping, splits
from seriesloom.operators import smoothing as sm
from seriesloom.plans import masters


def day(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def gaps(spark):
    """Random gaps in four series, one of them with no value at all."""
    rnd = random.Random(11)
    rows = [(k, day(i), None if rnd.random() < 0.5 or k == "none" else rnd.uniform(1, 9)) for k in ("a", "b", "c", "none") for i in range(30)]
    return spark.createDataFrame(rows, "k string, ts date, v double"), pd.DataFrame(rows, columns=["k", "ts", "v"])


def by_key(df, value="v"):
    out = {}
    for r in df.orderBy("k", "ts").collect():
        out.setdefault(r.k, []).append(r[value])
    return out


def same(a, b):
    return all((x is None and pd.isna(y)) or (x is not None and abs(x - y) < 1e-9) for x, y in zip(a, b))


@pytest.mark.parametrize("edge", ["both", "forward"])
def test_interpolate_matches_pandas(gaps, edge):
    df, pdf = gaps
    got = by_key(fill.interpolate(df, "k", "ts", ["v"], edge=edge))
    for k, g in pdf.groupby("k"):
        want = g.v.astype(float).interpolate("linear", limit_direction=edge)
        assert same(got[k], list(want)), k


def test_fixture_example(spark):
    df = spark.createDataFrame([("A", day(i), v) for i, v in enumerate([None, 10.0, None, 16.0, None])], "k string, ts date, v double")
    assert by_key(fill.interpolate(df, "k", "ts", ["v"]))["A"] == [10, 10, 13, 16, 16]
    assert by_key(fill.interpolate(df, "k", "ts", ["v"], edge="forward"))["A"] == [None, 10, 13, 16, 16]


def test_fill_both_ways_matches_pandas(gaps):
    df, pdf = gaps
    got = by_key(fill.fill_both_ways(df, "k", "ts", ["v"]))
    for k, g in pdf.groupby("k"):
        assert same(got[k], list(g.v.astype(float).ffill().bfill())), k


def test_quadratic_reproduces_parabola(spark):
    truth = [3 + 2 * i - 0.5 * i * i for i in range(12)]
    kept = {0, 3, 4, 9, 11}
    df = spark.createDataFrame([("A", day(i), truth[i] if i in kept else None) for i in range(12)], "k string, ts date, v double")
    assert same(by_key(fill.interpolate_quadratic(df, "k", "ts", "v"))["A"], truth)


def test_regularise_creates_empty_months(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(4), 2.0), ("b", day(2), 3.0)], "k string, ts date, v double")
    shared = by_key(cal.regularise(df, "k"))
    assert shared == {"a": [1.0, None, None, None, 2.0], "b": [None, None, 3.0, None, None]}
    assert by_key(cal.regularise(df, "k", shared_range=False))["b"] == [3.0]


def test_yearly_to_monthly_example(spark):
    df = spark.createDataFrame([("A", 2000, 120.0), ("A", 2001, 132.0), ("one", 2000, 5.0)], "k string, year int, v double")
    out = cal.yearly_to_monthly(df, "k", "year", ["v"])
    got = by_key(out)
    assert set(got) == {"A"}
    assert got["A"] == pytest.approx([120.0 + i for i in range(12)] + [132.0 + i for i in range(12)])


def test_flat_months_start_in_february(spark):
    df = spark.createDataFrame([("A", 2001, 7.0)], "k string, year int, v double")
    out = cal.after_last_year(cal.spread_flat(df, "k", "year", "v"), F.lit(2000)).orderBy("ts").collect()
    assert len(out) == 11 and out[0].ts == dt.date(2001, 2, 1)


def test_anchored_months_pass_through_december(spark):
    df = spark.createDataFrame([("A", 2000, 10.0), ("A", 2002, 34.0)], "member string, year int, total double")
    got = {r.ts: r.total for r in masters.anchored_member_months(df).collect()}
    assert len(got) == 25 and got[dt.date(2000, 12, 1)] == 10.0 and got[dt.date(2001, 12, 1)] == 22.0


def test_features_never_cross_members_or_see_the_future(spark, series):
    df, rows = series
    base = {(r.member, r.ts): r for r in ft.add_time_features(df, "total", "member").collect()}
    assert base[("B", day(0))].lag_1 is None and base[("B", day(11))].lag_12 is None
    assert base[("B", day(1))].rolling_mean_3 is None
    vals = [r[2] for r in rows if r[0] == "B"]
    assert base[("B", day(20))].lag_12 == vals[8]
    assert base[("B", day(20))].rolling_mean_3 == pytest.approx(sum(vals[18:21]) / 3)
    changed = df.withColumn("total", F.when(F.col("ts") > day(30), F.lit(-1.0)).otherwise(F.col("total")))
    after = {(r.member, r.ts): r for r in ft.add_time_features(changed, "total", "member").collect()}
    assert all(after[k].lag_1 == base[k].lag_1 and after[k].rolling_mean_3 == base[k].rolling_mean_3 for k in base if k[1] <= day(30))


def test_proxy_and_scaler(spark):
    df = spark.createDataFrame([("a", i, float(v), 5.0) for i, v in enumerate([2, 4, 6, 8])], "k string, t int, v double, flat double")
    got = [r.p for r in df.withColumn("p", ft.proxy_from_mean("v", "k", "t", 3)).orderBy("t").collect()]
    assert got == [1.0, 1.5, 2.0, 3.0]
    stats = ft.scaler(df, "k", ["v", "flat"], F.col("t") < 2)
    z = ft.standardise(df, stats, "k", ["v", "flat"]).orderBy("t").collect()
    assert [r.v for r in z] == [-1.0, 1.0, 3.0, 5.0] and all(r.flat == 0.0 for r in z)


def test_splits(spark, series):
    df, _ = series
    rows = splits.three_way(df, "member", "ts").collect()
    sizes = {s: sum(r.split == s and r.member == "A" for r in rows) for s in ("TRAIN", "VAL", "TEST")}
    assert sizes == {"TRAIN": 42, "VAL": 6, "TEST": 12}  # 60 rows: 42, min(max(54, 48), 48)
    assert max(r.ts for r in rows if r.split == "TRAIN") < min(r.ts for r in rows if r.split == "VAL")
    short = df.where(F.col("ts") < day(40))
    assert splits.three_way(short, "member", "ts").count() == 0
    two = splits.two_way(df, "member", "ts", 0.999, lo=3, hi=2).where("member = 'A' AND split = 'TEST'")
    assert two.count() == 2


def test_require_rows(spark, series):
    df, _ = series
    assert splits.require_rows(df, 10, "too small").count() == 180
    with pytest.raises(Exception, match="too small"):
        splits.require_rows(df, 1000, "too small").collect()
    with pytest.raises(Exception, match="too small"):
        splits.require_rows(df.where("1 = 0"), 10, "too small").collect()


def test_min_size_and_members_with_sizes(spark):
    df = spark.createDataFrame([("a", y) for y in range(2014, 2025)] + [("b", y) for y in range(2022, 2025)], "k string, y int")
    assert {r.k for r in splits.min_size(df, "k", 5).collect()} == {"a"}
    tagged = splits.by_year(df, F.col("y"), 2020, 2022)
    assert {r.k for r in splits.members_with_sizes(tagged, "k", {"TRAIN": 3, "VAL": 1, "TEST": 1}).collect()} == {"a"}


def test_seasonal_naive_example(spark):
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6, 0, 0, 0, 0])], "k string, rn int, y double")
    got = [r.predicted for r in sm.seasonal_naive(df, "k", "y", F.lit(6), 3).orderBy("rn").collect()]
    assert got == [None, None, None, 1, 2, 3, 4, 5, 6, 4]
    short = sm.seasonal_naive(df, "k", "y", F.lit(2), 3).where("rn > 2").collect()
    assert {r.predicted for r in short} == {2.0}


def test_schema_operators(spark):
    df = spark.createDataFrame([(1, " x ", 2.0)], "a int, `Yearly Change_` string, d double")
    clean = shaping.clean_headings(df)
    assert clean.columns == ["a", "Yearly_Change", "d"]
    assert shaping.apply_aliases(clean, {"Density": ["nope", "d"]}).first().Density == 2.0
    assert shaping.keep_available(clean, ["d", "zzz", "a"]).columns == ["d", "a"]
    assert shaping.reindex_columns(clean, ["d", "new"], 0.5).first() == (2.0, 0.5)
    assert shaping.insert_column(clean, 1, "x", F.lit(9)).columns == ["a", "x", "Yearly_Change", "d"]
    need = shaping.require_numeric(clean, ["d", "gone"]).first()
    assert need.d == 2.0 and need.gone is None
    assert shaping.exclude(clean, "a", ["d"]) == ["Yearly_Change"]
    assert shaping.rename_positional(clean, ["p", "q", "r"]).columns == ["p", "q", "r"]
    hot = shaping.one_hot(clean.withColumn("s", F.lit("u")), "s", ["u", "v"]).first()
    assert (hot.s_u, hot.s_v) == (1, 0)


def test_statistics_table_cleanup(spark):
    raw = spark.createDataFrame(
        [(1, "2,020", "21,000", "50 %"), (2, "2020", "22,000", "50 %"), (3, "N.A.", "1", "1"), (4, "2021", "", "1")],
        "no int, ` Year` string, Population string, `Urban Pop` string",
    )
    out = masters.standardise_statistics(raw, order="no").collect()
    assert len(out) == 1
    row = out[0]
    assert (row.Year, row.National_Population, row.Urban_Population) == (2020, 22000.0, 11000.0)
    assert row.Population_Density == pytest.approx(22000 / 62710) and str(row.Date) == "2020-12-31"
