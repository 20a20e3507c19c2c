import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import arima as ar
from seriesloom.operators import boosting as bo
from seriesloom.operators import piecewise as pw
from seriesloom.operators import registry as rgy
from seriesloom.operators import regression as rg
from seriesloom.operators import smoothing as sm
from seriesloom.operators import splits
from seriesloom.session import scratch_path
from seriesloom.sources.sinks import KeyedStore


@pytest.fixture(scope="module")
def fitted(spark):
    rnd = random.Random(6)
    rows = [(m, dt.date(2000 + i // 12, i % 12 + 1, 1), 50 + 3 * k + i * 0.4 + rnd.gauss(0, 1), rnd.random(), float(i)) for k, m in enumerate("ab") for i in range(72)]
    df = spark.createDataFrame(rows, "member string, ts date, y double, x1 double, x2 double")
    ranked = splits.ranked(df, "member", "ts")
    arrays = sm.as_arrays(df, "member", "ts", "y")
    return df, ranked, arrays


def test_each_kind_scores_as_its_operator(spark, fitted):
    df, ranked, arrays = fitted
    coefs = rg.fit(df, "member", ["x1", "x2"], "y", F.lit(True))
    trend = pw.fit_trend(arrays)
    ensemble = bo.fit(df, ["x2", "x1"], "y", [bo.Setting(30, 2, 0.2)])[0]
    order = ar.fit_grid(ranked, "member", "ts", "y", F.lit(True), ar.Grid(sp=(1,), q=(0,)), extra=8, method="css")
    first, last = rgy.month_number(F.element_at("tss", 1)), rgy.month_number(F.element_at("tss", -1))
    models = rgy.linear_models(coefs, "member", ["x1", "x2"]).unionByName(rgy.piecewise_models(trend, "member", first))
    models = models.unionByName(rgy.tree_model(spark, ensemble, "a"))
    models = models.unionByName(rgy.arima_models(order, arrays.select("member", "ys", last.alias("last_month")), "member", F.col("last_month"), 12))
    store = KeyedStore(spark, scratch_path(spark, "models"), ["name", "member"])
    store.put(models)
    store.put(rgy.tree_model(spark, ensemble, "a"))  # a new version replaces one row
    assert store.version() == 2 and store.read().count() == models.count() == 7

    asked = df.withColumn("month", rgy.month_number(F.col("ts")))
    got = {(r.member, r.month, r.name): r.predicted for r in rgy.score(store.read(), asked, ["x1", "x2"]).collect()}
    for r in rg.predict(asked, coefs, "member", ["x1", "x2"]).collect():
        assert got[r.member, r.month, "linear"] == pytest.approx(r.predicted)
    for r in bo.scored(asked.where("member = 'a'"), ensemble).collect():
        assert got["a", r.month, "trees"] == pytest.approx(r.predicted)
    assert not any(m == "b" and n == "trees" for m, _, n in got)
    value = pw.forecast(trend, F.col("rn") - 1)
    for r in ranked.join(trend.select("member", "m", "cap", "n_obs"), "member").select("member", "ts", value.alias("p")).collect():
        assert got[r.member, r.ts.year * 12 + r.ts.month, "piecewise"] == pytest.approx(r.p)

    later = spark.createDataFrame([(m, 2006 * 12 + h, 0.5, 1.0) for m in "ab" for h in range(1, 9)], "member string, month int, x1 double, x2 double")
    ahead = {(r.member, r.month - 2006 * 12, r.name): r.predicted for r in rgy.score(store.read(), later, ["x1", "x2"]).collect()}
    for r in ar.predictions(order, "member").where("rn > train_n").collect():
        assert ahead[r.member, r.rn - r.train_n, "arima"] == pytest.approx(r.predicted)
    wide = rgy.wide(rgy.score(store.read(), later, ["x1", "x2"]), ["linear", "piecewise", "trees", "arima"], ["member", "month"]).collect()
    for r in wide:
        values = [v for v in (r.linear, r.piecewise, r.trees, r.arima) if v is not None]
        assert r.n_models == len(values) == (4 if r.member == "a" else 3) and r.ensemble == pytest.approx(sum(values) / len(values))


def test_members_without_models_give_no_rows(spark):
    none = spark.createDataFrame([], rgy.MODEL)
    asked = spark.createDataFrame([("a", 5, 1.0)], "member string, month int, x double")
    assert rgy.score(none, asked, ["x"]).collect() == []
