import datetime as dt
import math

import pytest
from series_values import values_of
from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.operators import backtest as bt
from seriesloom.operators import forecasting as fc
from seriesloom.operators import metrics as mt
from seriesloom.operators import selection as sel
from seriesloom.operators import smoothing as sm
from seriesloom.operators import splits
from test_models import holt_loop


@pytest.fixture(scope="module")
def preds(spark):
    rows = [("m", "TRAIN", 10.0, 11.0), ("m", "TRAIN", 20.0, 18.0), ("m", "VAL", 0.0, 1.0), ("m", "VAL", 4.0, 5.0), ("m", "TEST", 5.0, None), ("m", "TEST", 8.0, float("nan")), ("m", "TEST", 8.0, 6.0)]
    return spark.createDataFrame(rows, "model string, split string, actual double, predicted double")


def test_bundle_skips_zero_actuals_and_invalid_predictions(preds):
    got = {r.split: r for r in mt.bundle(preds, ["split"]).collect()}
    assert got["TRAIN"].rmse == pytest.approx(math.sqrt(2.5)) and got["TRAIN"].mape == pytest.approx(10.0)
    assert got["TRAIN"].r2 == pytest.approx(1 - 5 / 50)
    assert got["VAL"].mape == 25.0 and got["TEST"].n_rows == 1 and got["TEST"].mae == 2.0
    wide = mt.split_bundle(preds, ["model"]).first()
    assert (wide.train_mae, wide.val_mape, wide.test_rmse) == (1.5, 25.0, 2.0)


def test_unguarded_mape_fails_on_zero(preds):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        preds.agg(mt.mape(F.col("actual"), F.col("predicted"), zero="error")).collect()


def test_exploded_rmse_is_infinite(spark):
    df = spark.createDataFrame([(1.0, 1e200), (2.0, 2.0)], "a double, p double")
    assert df.agg(mt.rmse_guarded(F.col("a"), F.col("p")).alias("v")).first().v == float("inf")


def test_mase_of_lag_naive_on_train_is_one(series):
    df = splits.ranked(series[0], "member", "ts")
    naive = bt.naive(df, "member", "ts", "total").withColumnRenamed("total", "actual")
    out = mt.with_mase(mt.bundle(naive, ["member"]), mt.naive_scale(df, "member", "ts", "total"), "member")
    assert all(r.mase == pytest.approx(1.0) for r in out.collect())
    flat = df.withColumn("total", F.lit(3.0))
    assert mt.naive_scale(flat, "member", "ts", "total").first().scale is None


def test_walk_forward_sees_only_the_past(series):
    df = series[0]
    run = {"NAIVE": bt.naive, "SEASONAL": bt.seasonal(12), "TREND": bt.line, "HOLT": bt.holt_refit(sm.param_rows(damped=True))}
    base = {(r.member, r.fold, r.pipeline): r.predicted for r in bt.walk_forward(df, "member", "ts", "total", run, 24).collect()}
    assert len(base) == 3 * 36 * 4
    cut = sorted({k[1] for k in base})[10]
    changed = df.withColumn("total", F.when(F.col("ts") >= cut, F.col("total") * 7).otherwise(F.col("total")))
    after = {(r.member, r.fold, r.pipeline): r.predicted for r in bt.walk_forward(changed, "member", "ts", "total", run, 24).collect()}
    assert all(after[k] == base[k] for k in base if k[1] <= cut)


def test_holt_refit_equals_refit_of_each_prefix(series):
    grid = sm.param_rows(damped=False)[:8]
    out = bt.walk_forward(series[0], "member", "ts", "total", {"HOLT": bt.holt_refit(grid)}, 30).where("member = 'A'").orderBy("fold").collect()
    y = values_of(series[1], "A")
    for i, row in enumerate(out, start=30):
        fits = [(holt_loop(y[:i], g["alpha"], g["beta"], g["phi"]), g) for g in grid]
        (level, trend, _, _), g = min(fits, key=lambda f: (f[0][3], f[1]["alpha"], f[1]["beta"]))
        assert row.predicted == pytest.approx(level + g["phi"] * trend)


def test_fold_summary(spark):
    rows = [("s", y, "P", float(a), p) for y, a, p in [(2000, 10, 11.0), (2001, 14, 13.0), (2002, 20, float("nan")), (2003, 20, 22.0)]]
    df = spark.createDataFrame(rows, "series string, fold int, pipeline string, actual double, predicted double")
    r = mt.fold_summary(df, "pipeline", "series").first()
    assert (r.n_folds, r.fold_years, r.mae) == (3, "2000-2003", pytest.approx(4 / 3))
    assert r.mase == pytest.approx((4 / 3) / ((4 + 6) / 2)) and r.accuracy_percent == pytest.approx(100 - r.mape)


def test_leaderboards(spark):
    cols = "member string, model string, params string, train_mape double, val_mape double, val_rmse double, test_rmse double"
    df = spark.createDataFrame(
        [("a", "X", "1", 1.0, 2.0, 5.0, 1.0), ("a", "Y", "1", 2.0, 2.0, 5.0, 1.0), ("b", "X", "1", 0.1, 0.4, 1.0, 9.0), ("b", "X", "2", None, None, None, None)], cols
    )
    board = {r.member: r for r in sel.member_leaderboard(df, "member").collect()}
    assert board["a"].model == "Y" and board["b"].selection_score == 0.4
    assert (board["b"].overall_rank_by_val, board["a"].overall_rank_by_val) == (1, 2)
    fam = {r.model: r for r in sel.best_per_family(df.withColumn("params", F.concat("member", "params"))).collect()}
    assert fam["X"].params == "b1" and fam["X"].rank_by_val == 1 and fam["Y"].rank_by_val == 2


def test_ensemble_lies_between_members(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 14.0), (1, None), (1, float("nan"))], "t int, predicted double")
    r = fc.ensemble(df, ["t"]).first()
    assert (r.ensemble, r.n_models) == (12.0, 2)


def test_lookups(spark):
    import datetime as dt

    fcst = spark.createDataFrame([("Alpha", dt.date(2025, 1, 1), 5.0)], "member string, ts date, v double")
    hist = spark.createDataFrame([("Alpha", dt.date(2025, 1, 1), 4.0), ("Alpha", dt.date(2024, 12, 1), 3.0)], "member string, ts date, p double")
    req = spark.createDataFrame([(1, "alpha", dt.date(2025, 1, 20)), (2, "ALPHA", dt.date(2024, 12, 2)), (3, "Beta", dt.date(2025, 1, 1))], "id int, member string, d date")
    got = {r.id: r for r in fc.lookup_member(req, fcst, hist, "member", "d", "ts", "v", "p").collect()}
    assert (got[1].predicted_value, got[1].value_type, got[1].matched_member) == (5.0, "forecast", "Alpha")
    assert (got[2].predicted_value, got[2].value_type) == (3.0, "historical_actual")
    assert (got[3].status, got[3].predicted_value) == ("not_found", None)


def test_allocation_formula(spark):
    import datetime as dt

    nat = spark.createDataFrame([(dt.date(2024, 11, 1), 900.0, 3.0, 90.0), (dt.date(2024, 12, 1), 1000.0, 4.0, 250.0)], "ts date, total double, density double, urban double")
    coefs = spark.createDataFrame([("a", 0.25, 0.0), ("b", 0.9, 0.0)], "member string, intercept double, slope double")
    out = fc.allocate(coefs, "member", nat, "2025-01-01", "2025-02-01").orderBy("member", "ts").collect()
    grown = 1000.0 * (1 + 0.008 * (31 / 30.44))
    assert len(out) == 4 and out[0].national == pytest.approx(grown) and out[0].density == 4.0
    assert out[0].urban == pytest.approx(grown / 4) and out[0].predicted_member == round(grown / 4)
    assert out[2].predicted_proportion == 0.9
    held = fc.allocate(coefs, "member", nat, limits=nm.SHARE_RANGE).orderBy("member", "ts").collect()
    assert len(held) == 48 and held[24].predicted_proportion == 0.5 and held[0].ts == dt.date(2025, 1, 1)


def test_allocation_of_many_members_adds_up(spark):
    nat = spark.createDataFrame([(dt.date(2024, 12, 1), 1e6, 4.0, 1.0)], "ts date, total double, density double, urban double")
    coefs = spark.range(1000).select(F.concat(F.lit("m"), "id").alias("member"), F.lit(0.001).alias("intercept"), F.lit(0.0).alias("slope"))
    out = fc.allocate(coefs, "member", nat, months=1).agg(F.sum("predicted_member").alias("s"), F.max("national").alias("n")).first()
    assert out.s == pytest.approx(out.n, rel=1e-3)


def test_failed_models_rank_last(spark):
    rows = [("a", "X", "{}", 1.0, None, None, 2.0), ("a", "Y", "{}", 1.0, 4.0, 4.0, 2.0), ("b", "X", "{}", 1.0, float("nan"), float("nan"), 2.0), ("c", "X", "{}", 1.0, 3.0, 3.0, 2.0)]
    df = spark.createDataFrame(rows, "member string, model string, params string, train_mape double, val_mape double, val_rmse double, test_rmse double")
    board = {r.member: (r.model, r.overall_rank_by_val) for r in sel.member_leaderboard(df, "member").collect()}
    assert board == {"c": ("X", 1), "a": ("Y", 2), "b": ("X", 3)}
    families = {r.model: r.rank_by_val for r in sel.best_per_family(df.where("member <> 'c'")).collect()}
    assert families == {"Y": 1, "X": 2}
