import datetime as dt

import numpy as np
import pytest
from series_values import values_of
from pyspark.sql import functions as F

from seriesloom.operators import arima as ar
from seriesloom.operators import backtest as bt
from seriesloom.operators import piecewise as pw
from seriesloom.operators import regression as rg
from seriesloom.operators import smoothing as sm
from seriesloom.operators import splits
from seriesloom.operators import trees as te
from seriesloom.operators import trend as tr
from seriesloom.plans import tuning as tn


def ranked(series):
    return splits.ranked(series[0], "member", "ts")


def train():
    return F.col("rn") <= 48


def test_quadratic_trend_matches_polyfit(series):
    coefs = tr.quadratic_trend(ranked(series), "member", "rn", "total", train())
    got = {(r.member, r.rn): r.predicted for r in tr.predict_quadratic(ranked(series), coefs, "member", "rn").collect()}
    for m in "ABC":
        p = np.polyfit(np.arange(1, 49), values_of(series[1], m)[:48], 2)
        assert [got[(m, i)] for i in range(1, 61)] == pytest.approx(list(np.polyval(p, np.arange(1, 61))), rel=1e-8)


def test_quadratic_needs_three_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "k string, x int, y double")
    assert tr.quadratic_trend(df, "k", "x", "y", F.lit(True)).first().c is None


def test_expanding_line_equals_refit_per_fold(series):
    got = {(r.member, r.rn): r.predicted for r in tr.expanding_line(ranked(series), "member", "rn", "total").collect()}
    y = values_of(series[1], "B")
    assert got[("B", 1)] is None and got[("B", 2)] is None
    for fold in range(3, 61):
        p = np.polyfit(np.arange(1, fold), y[: fold - 1], 1)
        assert got[("B", fold)] == pytest.approx(np.polyval(p, fold), rel=1e-9)


def test_ridge_trend_closed_form(series):
    got = {r.member: (r.intercept, r.slope) for r in tr.ridge_trend(ranked(series), "member", "rn", "total", train(), 7.0).collect()}
    x, y = np.arange(1, 49), np.array(values_of(series[1], "C")[:48])
    slope = ((x - x.mean()) @ (y - y.mean())) / ((x - x.mean()) @ (x - x.mean()) + 7.0)
    assert got["C"] == pytest.approx((y.mean() - slope * x.mean(), slope))


@pytest.mark.parametrize("ridge", [0.0, 10.0])
def test_regression_matches_numpy(series, ridge):
    df = ranked(series).withColumns({"a": F.sin(F.col("rn")), "b": F.col("rn") * 1000.0, "flat": F.lit(4.0)})
    xs = ["a", "b", "flat"]
    coefs = rg.fit(df, "member", xs, "total", train(), ridge)
    got = {(r.member, r.rn): r.predicted for r in rg.predict(df, coefs, "member", xs).collect()}
    i = np.arange(1, 61)
    x = np.column_stack([np.sin(i), i * 1000.0])
    mu, sd = x[:48].mean(0), x[:48].std(0)
    z, y = (x - mu) / sd, np.array(values_of(series[1], "A"))
    beta = np.linalg.solve(z[:48].T @ z[:48] + ridge * np.eye(2), z[:48].T @ (y[:48] - y[:48].mean()))
    assert [got[("A", int(k))] for k in i] == pytest.approx(list(y[:48].mean() + z @ beta), rel=1e-8)


def test_regression_reports_short_series(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0)], "k string, x double, y double")
    assert rg.fit(df, "k", ["x"], "y", F.lit(True)).first().status == "too few rows"


def test_lag_recursion(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0])], "k string, ys array<double>")
    got = [r.predicted for r in rg.lag_recursion(df, "ys", F.lit(1.0), [F.lit(0.5), F.lit(0.25)], 3).orderBy("h").collect()]
    path = [1.0, 2.0]
    for _ in range(3):
        path.append(1.0 + 0.5 * path[-1] + 0.25 * path[-2])
    assert got == path[2:]


def holt_loop(y, a, b, phi):
    level, trend, fit, sse = y[0], y[1] - y[0], [y[0]], 0.0
    for v in y[1:]:
        ahead = level + phi * trend
        fit.append(ahead)
        sse += (v - ahead) ** 2
        new = a * v + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * phi * trend
        level = new
    return level, trend, fit, sse


def test_holt_grid_and_best(series):
    arrays = sm.as_arrays(series[0], "member", "ts", "total")
    grid = sm.param_rows(damped=True)
    best = sm.best_params(sm.holt(sm.with_grid(arrays, grid), fitted=True), "member").where("member = 'B'").first()
    y = values_of(series[1], "B")
    want = min(grid, key=lambda g: (holt_loop(y, g["alpha"], g["beta"], g["phi"])[3], g["alpha"], g["beta"], g["phi"]))
    assert (best.alpha, best.beta, best.phi) == (want["alpha"], want["beta"], want["phi"])
    level, trend, fit, sse = holt_loop(y, best.alpha, best.beta, best.phi)
    assert (best.l, best.b, best.sse) == pytest.approx((level, trend, sse)) and list(best.f) == pytest.approx(fit)


def test_holt_winters_matches_loop(series):
    a, b, g, m = 0.3, 0.1, 0.2, 12
    state = sm.holt_winters(sm.with_grid(sm.as_arrays(series[0], "member", "ts", "total"), [{"alpha": a, "beta": b, "phi": 1.0, "gamma": g}]), m)
    got = state.where("member = 'C'").select("l", "b", "seas", "f", sm.holt_winters_forecast(F.lit(15), m).alias("h15")).first()
    y = values_of(series[1], "C")
    level, trend = np.mean(y[:m]), (np.mean(y[m : 2 * m]) - np.mean(y[:m])) / m
    seas, fit = [v - level for v in y[:m]], []
    for v in y:
        off, base = seas.pop(0), level + trend
        fit.append(base + off)
        new = a * (v - off) + (1 - a) * base
        trend = b * (new - level) + (1 - b) * trend
        seas.append(g * (v - new) + (1 - g) * off)
        level = new
    assert list(got.f) == pytest.approx(fit) and list(got.seas) == pytest.approx(seas)
    assert got.h15 == pytest.approx(level + 15 * trend + seas[2])


def hannan_rissanen(y, lags, p, q):
    """Reference two-stage fit of order (p, 1, q) by plain least squares, and its forecasts."""
    w = np.diff(y)
    top = max(lags)
    x = np.array([[1.0, *[w[t - k] for k in lags]] for t in range(top, len(w))])
    ar_beta = np.linalg.lstsq(x, w[top:], rcond=None)[0]
    e = np.full(len(w), np.nan)
    e[top:] = w[top:] - x @ ar_beta
    rows = [t for t in range(len(w)) if t >= p and t >= top + q]
    z = np.array([[*[w[t - k] for k in range(1, p + 1)], *[e[t - k] for k in range(1, q + 1)]] for t in rows])
    beta = np.linalg.lstsq(z, w[rows], rcond=None)[0]
    fitted = {t + 2: y[t] + float(z[i] @ beta) for i, t in enumerate(rows)}  # 1-based position of y
    ws, es, ys = list(w), list(e), list(y)
    for _ in range(12):
        new = sum(beta[k - 1] * ws[-k] for k in range(1, p + 1)) + sum(beta[p + k - 1] * es[-k] for k in range(1, q + 1))
        ws.append(new)
        es.append(0.0)
        ys.append(ys[-1] + new)
    return beta, fitted, ys[len(y) :]


def test_arima_matches_brute_force(series):
    rows = ranked(series).withColumn("split", F.when(F.col("rn") <= 48, "TRAIN").otherwise("TEST"))
    grid = ar.Grid(p=(1, 2), d=(1,), q=(1,))
    fits = ar.fit_grid(rows, "member", "ts", "total", train(), grid)
    preds = ar.predictions(fits, "member").where("member = 'A' AND p = 2").collect()
    got = {r.rn: r.predicted for r in preds}
    _, fitted, ahead = hannan_rissanen(np.array(values_of(series[1], "A")[:48]), grid.long_ar, 2, 1)
    assert [got[49 + i] for i in range(12)] == pytest.approx(ahead, rel=1e-6)
    assert all(got[k] == pytest.approx(v, rel=1e-6) for k, v in fitted.items() if k in got) and len(got) - 12 <= len(fitted)


def test_seasonal_differencing_is_undone(spark):
    """A pure season plus line has zero seasonal difference noise, so (0,1,0)(0,1,0) repeats it exactly."""
    rows = [("a", dt.date(2000 + i // 12, i % 12 + 1, 1), 10.0 * (i % 12) + 2.0 * i) for i in range(72)]
    df = splits.ranked(spark.createDataFrame(rows, "member string, ts date, total double"), "member", "ts")
    grid = ar.Grid(p=(0,), d=(1,), q=(0,), sd=(1,), season=12)
    fits = ar.fit_grid(df, "member", "ts", "total", F.col("rn") <= 48, grid)
    got = {r.rn: r.predicted for r in ar.predictions(fits, "member").where("rn > 48").collect()}
    assert [got[i + 1] for i in range(48, 72)] == pytest.approx([r[2] for r in rows[48:]])


def test_grid_shapes():
    grid = ar.seasonal_grid()
    assert len(grid.orders()) * len(grid.variants()) == 216
    both = next(v for v in grid.variants() if v["d"] == 1 and v["sd"] == 1)
    assert both["weights"] == {1: -1.0, 12: -1.0, 13: 1.0}


def test_automatic_order_has_least_aic(series):
    fits = ar.fit_grid(ranked(series), "member", "ts", "total", F.lit(True), ar.Grid(p=(0, 1, 2), d=(0, 1), q=(0, 1)), common=True)
    rows = fits.collect()
    assert len({r.n for r in rows}) == 1
    best = {r.member: r.aic for r in ar.pick_by_aic(fits, "member").collect()}
    for m in "ABC":
        assert best[m] == min(r.aic for r in rows if r.member == m and r.status == "ok")


def test_short_series_fit_fails_as_a_row(spark):
    df = spark.createDataFrame([("a", dt.date(2000, i, 1), float(i * i)) for i in range(1, 5)], "member string, ts date, total double")
    fits = ar.fit_grid(splits.ranked(df, "member", "ts"), "member", "ts", "total", F.lit(True), ar.Grid())
    assert {r.status for r in fits.collect()} <= {"failed"}


def test_every_order_on_a_smooth_large_series(spark):
    """All 216 orders at level 2e7: coefficients, error and AIC are those of a plain fit, and every held-out row is scored."""
    noise = np.random.default_rng(2).normal(0, 25, 240)
    y = [float(2e7 * (1.0 + 0.0009 * i) + 300.0 * np.sin(i / 7.0) + 40.0 * (i % 12) + noise[i]) for i in range(240)]
    rows = [("a", dt.date(1990 + i // 12, i % 12 + 1, 1), v) for i, v in enumerate(y)]
    split = tn.split_rows(spark.createDataFrame(rows, "member string, ts date, total double"), "member", "ts")
    grid = ar.seasonal_grid()
    fits = ar.fit_grid(split, "member", "ts", "total", F.col("split") == "TRAIN", grid, split="split").collect()
    assert len(fits) == 216 and {r.status for r in fits} == {"ok"}
    assert all(not np.isnan(r.predicted[-72:]).any() and len(r.predicted) == 240 for r in fits)
    for r in fits:
        w = np.array(y)
        for lag in [1] * r.d + [12] * r.sd:
            w = np.concatenate([np.full(lag, np.nan), w[lag:] - w[:-lag]])
        back = [np.concatenate([np.full(k, np.nan), w[:-k]]) for k in grid.long_ar]
        z = np.column_stack([np.ones(240), *back])
        ok = np.isfinite(z).all(1) & np.isfinite(w) & (np.arange(240) < 168)
        e = w - z @ np.linalg.lstsq(z[ok], w[ok], rcond=None)[0]
        ws = [np.concatenate([np.full(k, np.nan), w[:-k]]) for k in (1, 2, 12)]
        es = [np.concatenate([np.full(k, np.nan), e[:-k]]) for k in (1, 2, 12)]
        ok = np.isfinite(np.column_stack([*ws, *es])).all(1) & np.isfinite(w) & (np.arange(240) < 168)
        chosen = ws[: r.p] + ([ws[2]] if r.sp else []) + es[: r.q] + ([es[2]] if r.sq else [])
        x = np.column_stack(([np.ones(240)] if r.d + r.sd == 0 else []) + chosen) if chosen or r.d + r.sd == 0 else np.zeros((240, 0))
        beta = np.linalg.lstsq(x[ok], w[ok], rcond=None)[0] if x.shape[1] else np.zeros(0)
        sse = float(((w[ok] - x[ok] @ beta) ** 2).sum())
        k = r.p + r.d + r.q + r.sp + r.sd + r.sq + 1
        assert r.aic == pytest.approx(ok.sum() * np.log(sse / ok.sum()) + 2 * k, rel=1e-6)


def test_piecewise_linear_and_logistic(spark):
    line = [5.0 + 3.0 * i for i in range(40)]
    cap = 1.05 * 100.0
    curve = [cap / (1 + np.exp(-(-2 + 0.1 * i))) for i in range(39)] + [100.0]
    df = spark.createDataFrame([("line", line), ("curve", [float(v) for v in curve])], "k string, ys array<double>")
    lin = pw.fit_trend(df.where("k = 'line'"), "linear", changepoints=10)
    got = lin.select(pw.forecast(lin, F.lit(45), "linear").alias("v")).first().v
    assert got == pytest.approx(5 + 3 * 45, rel=1e-6)
    log = pw.fit_trend(df.where("k = 'curve'"), "logistic", changepoints=0)
    got = log.select(pw.forecast(log, F.lit(10), "logistic").alias("v"), "cap").first()
    assert got.cap == pytest.approx(105.0) and got.v == pytest.approx(curve[10], rel=0.05)


def test_piecewise_matches_direct_ridge(spark):
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=50)) + 20
    df = spark.createDataFrame([("a", [float(v) for v in y])], "k string, ys array<double>")
    m = pw.fit_trend(df, "linear", changepoints=5, prior_scale=0.5)
    got = m.select("m", pw.forecast(m, F.lit(30), "linear").alias("v")).first()
    t, knots = np.arange(50) / 49, np.array(got.m.knots)
    assert len(knots) == 5 and knots.max() <= 0.8
    x = np.column_stack([np.ones(50), t, np.maximum(t[:, None] - knots, 0)])
    beta = np.linalg.solve(x.T @ x + np.diag([0, 0, *[2.0] * 5]), x.T @ y)
    assert got.v == pytest.approx(float(x[30] @ beta), rel=1e-6)


def test_theta_matches_loop(series):
    state = sm.theta(sm.with_grid(sm.as_arrays(series[0], "member", "ts", "total"), [{"alpha": 0.4, "beta": 0.0, "phi": 1.0, "gamma": 0.0}]))
    got = state.where("member = 'A'").select(sm.theta_forecast(F.lit(3)).alias("v")).first().v
    y = values_of(series[1], "A")
    level = y[0]
    for v in y:
        level += 0.4 * (v - level)
    slope = np.polyfit(np.arange(60), y, 1)[0]
    assert got == pytest.approx(level + slope / 2 * (3 - 1 + 1 / 0.4 - 0.6**60 / 0.4))


def test_recursive_tree_forecast_feeds_itself(series):
    df = splits.ranked(series[0], "member", "ts")
    lagged = df.withColumn("_f_lag", F.lag("total").over(__import__("pyspark").sql.Window.partitionBy("member").orderBy("ts"))).na.drop()
    model = te.fit_forest(lagged, ["_f_lag"], "total", {"numTrees": 3, "maxDepth": 3})
    state = sm.as_arrays(series[0], "member", "ts", "total").select("member", "ys", F.array_max("tss").alias("at"))
    out = te.recursive_forecast(model, state, lambda ys, at: {"lag": F.element_at(ys, -1)}, 4, lambda at: F.add_months(at, 1), checkpoint_every=2)
    got = {(r.member, r.h): r.predicted for r in out.collect()}
    from pyspark.ml.linalg import Vectors

    last = values_of(series[1], "B")[-1]
    for h in range(1, 5):
        last = model.predict(Vectors.dense([last]))
        assert got[("B", h)] == pytest.approx(last)


def test_theta_and_ets_candidates_cover_validation_and_test(series):
    rows = tn.split_rows(series[0], "member", "ts")
    for make in (tn.theta_candidate, tn.ets_candidate, tn.holt_candidate):
        scores = tn.candidate_scores([make(rows, "member", "ts", "total")], "member").collect()
        assert len(scores) == 3 and all(r.val_mape is not None and r.test_mape is not None for r in scores)
    theta = tn.candidate_scores([tn.theta_candidate(rows, "member", "ts", "total")], "member").first()
    assert theta.train_mape is None


def test_seasonal_naive_test_part_uses_validation(series):
    rows = tn.split_rows(series[0], "member", "ts")
    got = {(r.member, r.rn): r.predicted for r in tn.seasonal_naive_candidate(rows, "member", "total").collect()}
    y = values_of(series[1], "A")
    assert got[("A", 43)] == y[42 - 12] and got[("A", 49)] == y[48 - 12] and got[("A", 60)] == y[59 - 12]
    assert got[("A", 5)] is None


def test_fold_refits_equal_a_refit_of_each_prefix(series):
    df = series[0].where("member = 'B'")
    y = np.array(values_of(series[1], "B"))
    grid = ar.Grid()
    line = {r.ts: r.predicted for r in bt.lag_line(df, "member", "ts", "total").collect()}
    step = {r.ts: r.predicted for r in bt.arima_refit(grid, 30)(df, "member", "ts", "total").collect()}
    for i, (_, ts, _) in enumerate([r for r in series[1] if r[0] == "B"]):
        if i >= 5:
            p = np.polyfit(y[: i - 1], y[1:i], 1)
            assert line[ts] == pytest.approx(np.polyval(p, y[i - 1]), rel=1e-8)
        if i >= 30:
            assert step[ts] == pytest.approx(ar.fit_variant(y[:i], i, grid, grid.variants()[0], extra=1)[0]["predicted"][-1])


def test_piecewise_regressors(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=60)
    y = 3.0 + 0.2 * np.arange(60) + 5.0 * z
    df = spark.createDataFrame([("a", [float(v) for v in y], [float(v) for v in z])], "k string, ys array<double>, zs array<double>")
    m = pw.fit_trend(df, "linear", changepoints=0, prior_scale=1e9, regressors=["zs"])
    got = m.select(pw.forecast(m, F.lit(70), "linear", [F.lit(2.0)]).alias("v")).first().v
    assert got == pytest.approx(3.0 + 0.2 * 70 + 10.0, rel=1e-6)
