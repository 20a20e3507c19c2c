"""Fitted models, forecasts, allocation, demand and serving."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.functions import time as tm
from seriesloom.operators import arima as ar
from seriesloom.operators import boosting as bo
from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import fill, joins, ranking, splits
from seriesloom.operators import forecasting as fc
from seriesloom.operators import metrics as mt
from seriesloom.operators import piecewise as pw
from seriesloom.operators import registry as rgy
from seriesloom.operators import regression as rg
from seriesloom.operators import selection as sel
from seriesloom.operators import smoothing as sm
from seriesloom.operators import trees as te
from seriesloom.operators import trend as tr
from seriesloom.operators.keys import literal_rows, one_value, series_window
from seriesloom.plans import bindings as bd
from seriesloom.plans import tuning as tn
from seriesloom.plans.catalog import base as b
from seriesloom.plans.catalog.base import big, ctes, query, rd
from seriesloom.session import checkpointed, scratch_path
from seriesloom.sources import sinks

def _is_train():
    return F.col("split") == "TRAIN"


# -- closed-form trends ----------------------------------------------------------------------------

_QUAD = """
mx AS (SELECT member, avg(rn) AS m FROM parts WHERE split = 'TRAIN' GROUP BY 1),
q AS (SELECT member, any_value(m) AS m, count(*) AS n, sum((rn - m) ** 2) AS s2, sum((rn - m) ** 3) AS s3, sum((rn - m) ** 4) AS s4, sum(total) AS t0, sum((rn - m) * total) AS t1, sum((rn - m) ** 2 * total) AS t2
  FROM parts JOIN mx USING (member) WHERE split = 'TRAIN' GROUP BY 1),
qc AS (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c FROM q),
qb AS (SELECT member, m, c, (t1 - s3 * c) / s2 AS b, (t0 - s2 * c) / n AS a FROM qc),
qp AS (SELECT p.*, a + b * (rn - m) + c * (rn - m) ** 2 AS predicted FROM parts p JOIN qb USING (member))
"""


@query(
    "M-01 E-05 E-15",
    ctes(b.SPLIT3, _QUAD)
    + "SELECT member, split, round(sqrt(avg((total - predicted) ** 2)), 2) AS rmse, round(avg(abs(total - predicted)), 2) AS mae, round(avg(abs((total - predicted) / total)) * 100, 4) AS mape FROM qp GROUP BY 1, 2",
)
def quadratic_trend_scores(spark, sf):
    rows = splits.three_way(bd.filled_panel(spark, sf), "member", "ts")
    coefs = tr.quadratic_trend(rows, "member", "rn", "total", _is_train())
    scored = tr.predict_quadratic(rows, coefs, "member", "rn").withColumnRenamed("total", "actual")
    m = mt.bundle(scored, ["member", "split"])
    return m.select("member", "split", rd("rmse", 2).alias("rmse"), rd("mae", 2).alias("mae"), rd("mape").alias("mape"))


@query(
    "M-02 M-19 M-20 C-08",
    ctes(
        b.YEARLY,
        "mx AS (SELECT member, avg(year) AS m, max(year) AS last_year FROM yearly GROUP BY 1)",
        "q AS (SELECT member, any_value(m) AS m, any_value(last_year) AS last_year, count(*) AS n, sum((year - m) ** 2) AS s2, sum((year - m) ** 3) AS s3, sum((year - m) ** 4) AS s4, sum(total) AS t0, sum((year - m) * total) AS t1, sum((year - m) ** 2 * total) AS t2 FROM yearly JOIN mx USING (member) GROUP BY 1)",
        "qc AS (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS c FROM q)",
        "qb AS (SELECT member, m, last_year, c, (t1 - s3 * c) / s2 AS b, (t0 - s2 * c) / n AS a FROM qc)",
        "f AS (SELECT member, last_year, CAST(last_year + h AS INT) AS year, a + b * (last_year + h - m) + c * (last_year + h - m) ** 2 AS predicted FROM qb, range(1, 16) AS t(h))",
    )
    + "SELECT member, CAST(make_date(year, CAST(mo AS INT), 1) AS DATE) AS ts, round(predicted, 0) AS predicted FROM f, range(1, 13) AS t(mo) "
    "WHERE make_date(year, CAST(mo AS INT), 1) >= CAST(make_date(last_year, 12, 31) + INTERVAL 1 MONTH AS DATE)",
)
def member_trend_horizon(spark, sf):
    """Quadratic trend of each member, fifteen years ahead, repeated over the months."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    coefs = tr.quadratic_trend(yearly, "member", "year", "total", F.lit(True))
    last = yearly.groupBy("member").agg(F.max("year").alias("last_year"))
    ahead = tr.predict_quadratic(cal.year_horizon(last, "last_year", 15), coefs, "member", "year")
    flat = cal.spread_flat(ahead, ["member", "last_year"], "year", "predicted")
    return cal.after_last_year(flat, F.col("last_year")).select("member", "ts", rd("predicted", 0).alias("predicted"))


_SHARES = """
sh AS (SELECT member, year, y.total / n.total AS proportion, CASE WHEN year <= (SELECT max(year) - 2 FROM ynat) THEN 'TRAIN' WHEN year <= (SELECT max(year) - 1 FROM ynat) THEN 'VAL' ELSE 'TEST' END AS split FROM yearly y JOIN ynat n USING (year)),
lr AS (SELECT member, regr_intercept(proportion, year) AS i1, regr_slope(proportion, year) AS s1, regr_sxy(proportion, year) / (regr_sxx(proportion, year) + 1.0) AS s2, avg(proportion) AS my, avg(year) AS mx FROM sh WHERE split = 'TRAIN' GROUP BY 1),
cmp AS (SELECT s.*, 'Linear' AS model, i1 + s1 * year AS predicted FROM sh s JOIN lr USING (member) UNION ALL SELECT s.*, 'Ridge', my - s2 * mx + s2 * year FROM sh s JOIN lr USING (member)),
vm AS (SELECT member, model, avg(abs((proportion - predicted) / proportion)) * 100 AS val_mape FROM cmp WHERE split = 'VAL' GROUP BY 1, 2),
pick AS (SELECT member, model, val_mape FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY val_mape, model) AS k FROM vm) WHERE k = 1)
"""


def _shares(spark, sf):
    yearly, total = bd.members_and_total(spark, sf)
    grand = total.select("year", F.col("total").alias("grand"))
    rows = checkpointed(ft.proportion(yearly.join(grand, "year"), "total", "grand"))
    last = one_value(total, F.max("year"))
    return splits.by_year(rows, F.col("year"), last - 2, last - 1)


def _share_predictions(spark, sf):
    rows = _shares(spark, sf)
    parts = []
    for name, fit in (("Linear", tr.linear_trend), ("Ridge", tr.ridge_trend)):
        coefs = fit(rows, "member", "year", "proportion", _is_train())
        parts.append(tr.predict_line(rows, coefs, "member", "year").withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query(
    "M-03 M-06",
    ctes(b.YEARLY, b.YEARLY_NATIONAL, _SHARES)
    + "SELECT member, model, year, split, round(proportion, 8) AS proportion, round(predicted, 8) AS predicted FROM cmp",
)
def share_trends(spark, sf):
    out = _share_predictions(spark, sf)
    return out.select("member", "model", "year", "split", rd("proportion", 8).alias("proportion"), rd("predicted", 8).alias("predicted"))


@query(
    "M-07",
    ctes(b.YEARLY, b.YEARLY_NATIONAL, _SHARES) + "SELECT member, model, round(val_mape, 6) AS val_mape FROM pick",
)
def best_share_model(spark, sf):
    preds = _share_predictions(spark, sf).where("split = 'VAL'")
    val = preds.groupBy("member", "model").agg(mt.mape(F.col("proportion"), F.col("predicted")).alias("val_mape"))
    best = tr.choose_by_validation(val, "member", "val_mape", "model", ["Linear", "Ridge"])
    return best.select("member", "model", rd("val_mape", 6).alias("val_mape"))


# -- multi-feature regression ----------------------------------------------------------------------

_MEMBER_X = ["fractional_year", "national", "density", "urban", "month_sin", "month_cos", "national_lag_1", "national_lag_12"]


def _member_rows(spark, sf, min_rows=48):
    wide = bd.member_master(spark, sf).na.drop("any")
    return tn.split_rows(wide, "member", "ts", min_rows)


@query("M-04 J-16")
def member_regression(spark, sf):
    """Share on eight features, one least-squares fit per member."""
    rows = _member_rows(spark, sf)
    coefs = rg.fit(rows, "member", _MEMBER_X, "proportion", _is_train())
    scored = rg.predict(rows, coefs, "member", _MEMBER_X).withColumnRenamed("proportion", "actual")
    return mt.bundle(scored, ["member", "split"])


_NATIONAL_X = ["fractional_year", "month_sin", "month_cos", "lag_1", "lag_12", *[f"{d}_lag1" for d in bd.DRIVERS]]


@query("M-05 M-06")
def national_regression(spark, sf):
    """Total on standardised features: least squares, and ridge with weight 1000."""
    rows = tn.split_rows(bd.national_master(spark, sf), "member", "ts")
    parts = []
    for name, weight in (("LINEAR", 0.0), ("RIDGE", 1000.0)):
        coefs = rg.fit(rows, "member", _NATIONAL_X, "total", _is_train(), ridge=weight)
        parts.append(rg.predict(rows, coefs, "member", _NATIONAL_X).select(F.lit(name).alias("model"), "split", F.col("total").alias("actual"), "predicted"))
    return mt.bundle(parts[0].unionByName(parts[1]), ["model", "split"])


@query("M-04")
def pooled_regression(spark, sf):
    """One regression over the rows of all members, by the distributed normal-equation solver."""
    from pyspark.ml.regression import LinearRegression

    rows = _member_rows(spark, sf)
    model = LinearRegression(featuresCol="_x", labelCol="proportion", solver="normal").fit(
        te.assemble(rows.where(_is_train()), _MEMBER_X)
    )
    scored = te.score(model, rows, _MEMBER_X).withColumnRenamed("proportion", "actual")
    return mt.bundle(scored, ["split"])


@query(
    "M-05 E-06",
    ctes(
        b.MEMBER_WIDE,
        "ok AS (SELECT member, ts, proportion AS y, national, density FROM wide WHERE density IS NOT NULL)",
        "s AS (SELECT member, avg(national) AS m1, stddev_pop(national) AS s1, avg(density) AS m2, stddev_pop(density) AS s2, avg(y) AS my FROM ok WHERE ts < make_date(" + b.LAST_YEAR + ", 1, 1) GROUP BY 1)",
        "z AS (SELECT member, ts, y, (national - m1) / s1 AS z1, (density - m2) / s2 AS z2, y - my AS yc, my FROM ok JOIN s USING (member))",
        "g AS (SELECT member, sum(z1 * z1) AS a, sum(z1 * z2) AS c, sum(z2 * z2) AS d, sum(z1 * yc) AS e, sum(z2 * yc) AS f FROM z WHERE ts < make_date(" + b.LAST_YEAR + ", 1, 1) GROUP BY 1)",
    )
    + "SELECT member, ts, round(my + z1 * (e * d - f * c) / (a * d - c * c) + z2 * (a * f - c * e) / (a * d - c * c), 8) AS predicted FROM z JOIN g USING (member)",
)
def two_feature_regression(spark, sf):
    """Least squares of the share on total and density, fitted on the months before the last complete year."""
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    wide = panel.join(nat, "ts", "left").join(bd.drivers(spark, sf).select("ts", "density"), "ts", "left")
    rows = checkpointed(ft.proportion(wide, "total", "national").na.drop("any"))
    xs = ["national", "density"]
    coefs = rg.fit(rows, "member", xs, "proportion", F.col("ts") < F.make_date(bd.last_complete_year(spark, sf), F.lit(1), F.lit(1)))
    return rg.predict(rows, coefs, "member", xs).select("member", "ts", rd("predicted", 8).alias("predicted"))


@query(
    "M-10",
    ctes(
        b.PANEL,
        "l AS (SELECT member, ts, total AS y, lag(total) OVER (PARTITION BY member ORDER BY ts) AS x FROM panel)",
        "c AS (SELECT member, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, max_by(y, ts) AS y0 FROM l GROUP BY 1)",
        "r AS (SELECT member, 0 AS h, a, b, y0 AS p FROM c UNION ALL SELECT member, h + 1, a, b, a + b * p FROM r WHERE h < 12)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, CAST(h AS BIGINT) AS h, round(p, 3) AS predicted FROM r WHERE h > 0",
)
def recursive_lag_forecast(spark, sf):
    """Twelve months ahead by a one-lag regression whose predictions feed its lag."""
    panel = ft.lags(bd.filled_panel(spark, sf), "member", "ts", {"x": ("total", 1)})
    coefs = tr.linear_trend(panel, "member", "x", "total", F.lit(True))
    last = panel.groupBy("member").agg(F.array(F.max_by("total", "ts")).alias("ys")).join(coefs, "member")
    out = rg.lag_recursion(last, "ys", F.col("intercept"), [F.col("slope")], 12)
    return out.select("member", big("h").alias("h"), rd("predicted", 3).alias("predicted"))


# -- trees -----------------------------------------------------------------------------------------

_TREE_X = ["fractional_year", "month_sin", "month_cos", "lag_1", "lag_12", "national_lag_1"]


@query("M-08")
def boosted_tree_scores(spark, sf):
    """Boosted trees over all members that stop when the validation rows gain no more; errors and number of kept trees of two settings."""
    rows = _member_rows(spark, sf).withColumn("is_val", F.col("split") == "VAL")
    parts = []
    for setting, model in zip(te.BOOSTED_GRID, bo.fit(rows.where("split <> 'TEST'"), _TREE_X, "total", te.BOOSTED_GRID, "is_val"), strict=True):
        scored = bo.scored(rows, model).withColumns({"params": F.lit(f"depth={setting.depth}"), "n_trees": F.lit(len(model.roots)).cast("long")})
        parts.append(scored.withColumnRenamed("total", "actual"))
    return mt.bundle(parts[0].unionByName(parts[1]), ["params", "n_trees", "split"])


def _round_sql(number: int, before: str) -> str:
    """One round of boosting with trees of one split on month and year, leaf penalty 1 and step 0.5."""
    sums = ", ".join(
        f"sum(CASE WHEN {f} <= s THEN r END) AS gl, count(CASE WHEN {f} <= s THEN 1 END) AS nl, sum(CASE WHEN {f} > s THEN r END) AS gr, count(CASE WHEN {f} > s THEN 1 END) AS nr" for f in ("m",)
    )
    halves = [f"SELECT '{f}' AS f, s, {sums.replace('CASE WHEN m ', f'CASE WHEN {f} ')} FROM {before}, (SELECT DISTINCT {f} AS s FROM {before}) GROUP BY s" for f in ("m", "yr")]
    return f"""
c{number} AS ({' UNION ALL '.join(halves)}),
b{number} AS (SELECT f, s, 0.5 * gl / (nl + 1) AS vl, 0.5 * gr / (nr + 1) AS vr FROM c{number} WHERE nl > 0 AND nr > 0 ORDER BY gl * gl / (nl + 1) + gr * gr / (nr + 1) DESC, f, s LIMIT 1),
r{number} AS (SELECT x.m, x.yr, x.y, x.r - CASE WHEN (f = 'm' AND m <= s) OR (f = 'yr' AND yr <= s) THEN vl ELSE vr END AS r FROM {before} x, b{number})
"""


@query(
    "M-08",
    ctes(b.PANEL, "r0 AS (SELECT CAST(month(ts) AS DOUBLE) AS m, CAST(year(ts) AS DOUBLE) AS yr, total AS y, total - avg(total) OVER () AS r FROM panel)", _round_sql(1, "r0"), _round_sql(2, "r1"))
    + "SELECT CAST(m AS BIGINT) AS month, CAST(yr AS BIGINT) AS year, round(any_value(y - r), 3) AS predicted FROM r2 GROUP BY m, yr",
)
def two_round_boosting(spark, sf):
    """Two trees of one split each on month and year, grown on all members."""
    rows = bd.filled_panel(spark, sf).select(F.month("ts").cast("double").alias("m"), F.year("ts").cast("double").alias("yr"), "total")
    model = bo.fit(rows, ["m", "yr"], "total", [bo.Setting(rounds=2, depth=1, step=0.5)])[0]
    return bo.scored(rows.select("m", "yr").distinct(), model).select(big("m").alias("month"), big("yr").alias("year"), rd("predicted", 3).alias("predicted"))


@query("M-09")
def forest_scores(spark, sf):
    rows = _member_rows(spark, sf)
    parts = []
    for params in te.FOREST_GRID:
        model = te.fit_forest(rows.where(_is_train()), _TREE_X, "total", params)
        scored = te.score(model, rows, _TREE_X).withColumn("params", F.lit(f"depth={params['maxDepth']}"))
        parts.append(scored.withColumnRenamed("total", "actual"))
    return mt.bundle(parts[0].unionByName(parts[1]), ["params", "split"])


@query("M-10")
def recursive_tree_forecast(spark, sf):
    """Eleven years ahead by boosted trees on their own predictions, all months of all members in one pass; boosting stops early on the last part of each series."""
    panel = checkpointed(bd.filled_panel(spark, sf))
    rows = splits.three_way(ft.add_time_features(panel, "total", "member").na.drop("any"), "member", "ts").withColumn("is_val", F.col("split") != "TRAIN")
    model = bo.fit(rows, ["lag_1", "lag_12", "month_sin", "month_cos"], "total", [te.BOOSTED_GRID[1]], "is_val")[0]
    state = sm.as_arrays(panel, "member", "ts", "total").select("member", F.slice("ys", F.size("ys") - 11, 12).alias("ys"), F.array_max("tss").alias("at"))
    return bo.recursive_forecast(model, state, {"lag_1": 1, "lag_12": 12}, {"month_sin": tm.month_sin, "month_cos": tm.month_cos}, 132, lambda at, h: F.add_months(at, h))


# -- smoothing -------------------------------------------------------------------------------------


def _holt_sql(alpha, beta, phi):
    return f"""
num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i FROM panel),
h AS (SELECT n.member, n.i, n.total AS l, n2.total - n.total AS b, 0.0::DOUBLE AS sse FROM num n JOIN num n2 ON n2.member = n.member AND n2.i = 2 WHERE n.i = 1
  UNION ALL SELECT n.member, n.i, {alpha} * n.total + (1 - {alpha}) * (h.l + {phi} * h.b), {beta} * ({alpha} * n.total + (1 - {alpha}) * (h.l + {phi} * h.b) - h.l) + (1 - {beta}) * {phi} * h.b,
    h.sse + (n.total - (h.l + {phi} * h.b)) ** 2 FROM h JOIN num n ON n.member = h.member AND n.i = h.i + 1)
"""


@query(
    "M-11",
    ctes(b.PANEL, _holt_sql("0.3::DOUBLE", "0.1::DOUBLE", "0.9::DOUBLE")).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, k AS h, round(l + b * 0.9::DOUBLE * (1 - 0.9::DOUBLE ** k) / (1 - 0.9::DOUBLE), 3) AS predicted, round(sqrt(sse), 3) AS root_sse FROM h, range(1, 13) AS t(k) WHERE i = (SELECT max(i) FROM num)",
)
def damped_trend_smoothing(spark, sf):
    series = sm.with_grid(sm.as_arrays(bd.filled_panel(spark, sf), "member", "ts", "total"), [{"alpha": 0.3, "beta": 0.1, "phi": 0.9, "gamma": 0.0}])
    state = sm.holt(series).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return state.select("member", big("h").alias("h"), rd(sm.holt_forecast(state, F.col("h")), 3).alias("predicted"), rd(F.sqrt("sse"), 3).alias("root_sse"))


_GRID_VALUES = ", ".join(f"({r['alpha']}::DOUBLE, {r['beta']}::DOUBLE)" for r in sm.param_rows())


@query(
    "J-09 M-11",
    ctes(
        b.PANEL,
        "num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i FROM panel)",
        f"g(alpha, beta) AS (SELECT * FROM (VALUES {_GRID_VALUES}))",
        "h AS (SELECT n.member, n.i, alpha, beta, n.total AS l, n2.total - n.total AS b, 0.0::DOUBLE AS sse FROM num n JOIN num n2 ON n2.member = n.member AND n2.i = 2, g WHERE n.i = 1 "
        "UNION ALL SELECT n.member, n.i, alpha, beta, alpha * n.total + (1 - alpha) * (h.l + h.b), beta * (alpha * n.total + (1 - alpha) * (h.l + h.b) - h.l) + (1 - beta) * h.b, h.sse + (n.total - (h.l + h.b)) ** 2 "
        "FROM h JOIN num n ON n.member = h.member AND n.i = h.i + 1)",
        "e AS (SELECT * FROM h WHERE i = (SELECT max(i) FROM num))",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, arg_min(alpha, sse) AS alpha, arg_min(beta, sse) AS beta, round(sqrt(min(sse)), 3) AS root_sse, count(*) AS n_params FROM e GROUP BY 1",
)
def smoothing_grid_search(spark, sf):
    series = sm.with_grid(sm.as_arrays(bd.filled_panel(spark, sf), "member", "ts", "total"), sm.param_rows())
    fits = sm.holt(series)
    best = sm.best_params(fits.select("member", "alpha", "beta", "phi", "gamma", "sse"), "member")
    sizes = fits.groupBy("member").agg(F.count(F.lit(1)).alias("n_params"))
    return best.join(sizes, "member").select("member", "alpha", "beta", rd(F.sqrt("sse"), 3).alias("root_sse"), "n_params")


_SEASONAL = [{"alpha": 0.3, "beta": 0.05, "phi": 1.0, "gamma": 0.2}]


@query(
    "M-11",
    ctes(
        b.PANEL,
        "num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i FROM panel)",
        "st AS (SELECT member, avg(CASE WHEN i <= 12 THEN total END) AS m1, avg(CASE WHEN i BETWEEN 13 AND 24 THEN total END) AS m2, list(total ORDER BY i) FILTER (WHERE i <= 12) AS y1 FROM num GROUP BY 1)",
        "h AS (SELECT member, CAST(0 AS BIGINT) AS i, m1 AS l, (m2 - m1) / 12 AS b, list_transform(y1, lambda v: v - m1) AS s, 0.0::DOUBLE AS sse FROM st "
        "UNION ALL SELECT member, i, nl, 0.05::DOUBLE * (nl - l) + (1 - 0.05::DOUBLE) * b, list_concat(s[2:], [0.2::DOUBLE * (y - nl) + (1 - 0.2::DOUBLE) * s[1]]), sse + (y - (l + b + s[1])) ** 2 FROM "
        "(SELECT h.member, n.i, h.l, h.b, h.s, h.sse, n.total AS y, 0.3::DOUBLE * (n.total - h.s[1]) + (1 - 0.3::DOUBLE) * (h.l + h.b) AS nl FROM h JOIN num n ON n.member = h.member AND n.i = h.i + 1))",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, k AS h, round(l + k * b + s[CAST((k - 1) % 12 + 1 AS INT)], 3) AS predicted, round(sqrt(sse), 3) AS root_sse FROM h, range(1, 25) AS t(k) WHERE i = (SELECT max(i) FROM num)",
)
def seasonal_smoothing(spark, sf):
    """Level, trend and season smoothing with fixed weights, two years ahead."""
    series = sm.with_grid(sm.as_arrays(bd.filled_panel(spark, sf), "member", "ts", "total"), _SEASONAL)
    state = sm.holt_winters(series, 12).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(24))))
    return state.select("member", big("h").alias("h"), rd(sm.holt_winters_forecast(F.col("h"), 12), 3).alias("predicted"), rd(F.sqrt("sse"), 3).alias("root_sse"))


@query(
    "M-12",
    ctes(
        b.PANEL,
        "num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i, count(*) OVER (PARTITION BY member) AS n FROM panel)",
        "sl AS (SELECT member, regr_slope(total, i) AS b, any_value(n) AS n FROM num GROUP BY 1)",
        "h AS (SELECT member, i, total AS l FROM num WHERE i = 1 UNION ALL SELECT n.member, n.i, h.l + 0.4::DOUBLE * (n.total - h.l) FROM h JOIN num n ON n.member = h.member AND n.i = h.i + 1)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT h.member, k AS h, round(l + b / 2 * (k - 1 + 1 / 0.4::DOUBLE - (1 - 0.4::DOUBLE) ** n / 0.4::DOUBLE), 2) AS predicted FROM h JOIN sl USING (member), range(1, 13) AS t(k) WHERE i = n",
)
def theta_forecast(spark, sf):
    """Theta forecast with a fixed smoothing weight and no seasonal adjustment."""
    series = sm.with_grid(sm.as_arrays(bd.filled_panel(spark, sf), "member", "ts", "total"), [{"alpha": 0.4, "beta": 0.0, "phi": 1.0, "gamma": 0.0}])
    state = sm.theta(series).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return state.select("member", big("h").alias("h"), rd(sm.theta_forecast(F.col("h")), 2).alias("predicted"))


@query(
    "M-12",
    ctes(
        b.PANEL,
        "c AS (SELECT *, (sum(total) OVER w5 + sum(total) OVER w6) / 24 AS cma, count(total) OVER w6 AS k FROM panel WINDOW w5 AS (PARTITION BY member ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), "
        "w6 AS (PARTITION BY member ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING))",
        "r AS (SELECT member, month(ts) AS month, avg(total / cma) AS raw FROM c WHERE k = 13 GROUP BY 1, 2)",
    )
    + "SELECT member, CAST(month AS BIGINT) AS month, round(raw / avg(raw) OVER (PARTITION BY member), 8) AS factor FROM r",
)
def seasonal_factors(spark, sf):
    out = tn.seasonal_factors(bd.filled_panel(spark, sf), "member", "ts", "total", F.lit(True))
    return out.select("member", big("_month").alias("month"), rd("factor", 8).alias("factor"))


@query("M-11 M-12 F-17")
def smoothing_scores(spark, sf):
    """Seasonal naive, damped trend, trend and season, and theta, each refit for the test part."""
    rows = tn.split_rows(bd.filled_panel(spark, sf), "member", "ts")
    parts = [
        tn.seasonal_naive_candidate(rows, "member", "total"),
        tn.holt_candidate(rows, "member", "ts", "total"),
        tn.ets_candidate(rows, "member", "ts", "total"),
        tn.theta_candidate(rows, "member", "ts", "total"),
    ]
    return tn.candidate_scores(parts, "member")


# -- ARIMA family ----------------------------------------------------------------------------------


@query(
    "M-13 M-10",
    ctes(
        b.PANEL,
        "d AS (SELECT member, ts, total, total - lag(total) OVER w AS w0, lag(total) OVER w - lag(total, 2) OVER w AS w1 FROM panel WINDOW w AS (PARTITION BY member ORDER BY ts))",
        "c AS (SELECT member, sum(CASE WHEN w1 IS NOT NULL THEN w0 * w1 END) / sum(CASE WHEN w1 IS NOT NULL THEN w1 * w1 END) AS phi, max_by(total, ts) AS y, max_by(w0, ts) AS wl FROM d GROUP BY 1)",
        "r AS (SELECT member, 0 AS h, phi, y, wl FROM c UNION ALL SELECT member, h + 1, phi, y + phi * wl, phi * wl FROM r WHERE h < 6)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, CAST(h AS BIGINT) AS h, round(phi, 8) AS phi, round(y, 3) AS predicted FROM r WHERE h > 0",
)
def difference_autoregression(spark, sf):
    """Order (1,1,0), whose least-squares estimate has a closed form; six months ahead."""
    rows = splits.ranked(bd.filled_panel(spark, sf), "member", "ts")
    grid = ar.Grid(p=(1,), d=(1,), q=(0,))
    fits = ar.fit_grid(rows, "member", "ts", "total", F.lit(True), grid, extra=6)
    weights = fits.select("member", F.get("beta", 1).alias("phi"))
    ahead = ar.predictions(fits, "member").join(weights, "member").where(F.col("rn") > F.col("train_n"))
    return ahead.select("member", big(F.col("rn") - F.col("train_n")).alias("h"), rd("phi", 8).alias("phi"), rd("predicted", 3).alias("predicted"))


@query("M-13")
def arima_scores(spark, sf):
    rows = tn.split_rows(bd.filled_panel(spark, sf), "member", "ts")
    return tn.arima_candidates(rows, "member", "ts", "total", ar.Grid(), "ARIMA")


@query("M-14 E-23 J-09")
def seasonal_grid_search(spark, sf):
    """All 216 seasonal orders of every member, scored; the best by validation error of each, with the number of orders that converged and that were dropped."""
    rows = tn.split_rows(bd.filled_panel(spark, sf), "member", "ts")
    fits = tn.arima_fits(rows, "member", "ts", "total", ar.seasonal_grid())
    scored = tn.arima_scored(fits, ["member"], ar.seasonal_grid(), "SARIMA")
    kept = F.count(F.when(F.col("status") == "ok", 1))
    sizes = fits.groupBy("member").agg(kept.alias("n_orders"), (F.count(F.lit(1)) - kept).alias("n_dropped"))
    return sel.best_per_member(scored, "member", "params").join(sizes, "member")


@query("M-15")
def exogenous_arima_scores(spark, sf):
    rows = _member_rows(spark, sf)
    preds = tn.exogenous_candidate(rows, "member", "ts", ["national", "density", "urban"], "proportion", ar.Grid())
    return tn.candidate_scores([preds], "member")


def _driver_series(spark, sf):
    long = joins.unpivot(bd.drivers(spark, sf), ["ts"], bd.DRIVERS, "member", "total")
    return checkpointed(splits.ranked(long, "member", "ts"))


@query("M-16")
def driver_forecasts(spark, sf):
    """Every driver column as its own series, one ARIMA each, for the months around the last observation.

    Steps at or before it, and series whose fit failed, take the last value.
    """
    rows = _driver_series(spark, sf)
    fits = ar.fit_grid(rows, "member", "ts", "total", F.lit(True), ar.Grid(), extra=6)
    last = rows.groupBy("member").agg(F.max("rn").alias("n"), F.max_by("total", "ts").alias("last_value"))
    asked = last.withColumn("h", F.explode(F.sequence(F.lit(-2), F.lit(6)))).withColumn("rn", F.col("n") + F.col("h"))
    out = asked.join(ar.predictions(fits, "member").select("member", "rn", "predicted"), ["member", "rn"], "left")
    value = F.when(F.col("h") > 0, F.coalesce("predicted", "last_value")).otherwise(F.col("last_value"))
    return out.select("member", "h", value.alias("predicted"))


@query("M-17 E-23")
def automatic_orders(spark, sf):
    """Order of least AIC per region among p, q up to 5 and d up to 2."""
    rows = splits.ranked(bd.filled_panel(spark, sf, "region"), "member", "ts")
    fits = ar.fit_grid(rows, "member", "ts", "total", F.lit(True), ar.auto_grid(), common=True, method="css")
    best = ar.pick_by_aic(fits, "member")
    return best.select("member", "p", "d", "q", "n", "aic", "aicc")


# -- piecewise trend -------------------------------------------------------------------------------


@query("M-18 M-19")
def piecewise_trend_scores(spark, sf):
    """Linear and logistic trends with changepoints, fitted on the train rows of each member."""
    rows = tn.split_rows(bd.filled_panel(spark, sf), "member", "ts")
    parts = []
    for growth in ("linear", "logistic"):
        model = pw.fit_trend(sm.as_arrays(rows, "member", "ts", "total", _is_train()), growth)
        value = pw.forecast(model, F.col("rn") - 1, growth)
        scored = rows.join(model.select("member", "m", "cap", "n_obs"), "member").withColumn("predicted", value)
        parts.append(scored.select("member", F.lit(growth).alias("growth"), "split", F.col("total").alias("actual"), "predicted"))
    return mt.bundle(parts[0].unionByName(parts[1]), ["growth", "split"])


@query("M-18")
def piecewise_regressor_scores(spark, sf):
    """Trends with few bends and two regressors beside the time, fitted on the train rows of each member: errors, and how many bends stay on average."""
    wide = bd.filled_panel(spark, sf).join(bd.drivers(spark, sf).select("ts", "density", "birth_rate"), "ts")
    rows = tn.split_rows(wide, "member", "ts")
    item = F.struct("ts", "total", "density", "birth_rate")
    packed = rows.where(_is_train()).groupBy("member").agg(F.array_sort(F.collect_list(item)).alias("r"))
    series = packed.select("member", F.col("r.total").alias("ys"), F.col("r.density").alias("density_s"), F.col("r.birth_rate").alias("birth_s"))
    parts = []
    for growth in ("linear", "logistic"):
        model = checkpointed(pw.fit_trend(series, growth, prior_scale=0.05, regressors=["density_s", "birth_s"], penalty="absolute").select("member", "m", "cap", "n_obs"))
        value = pw.forecast(model, F.col("rn") - 1, growth, [F.col("density"), F.col("birth_rate")])
        bends = F.size(F.filter(F.slice("m.beta", 3, F.size("m.knots")), lambda v: v != 0))
        scored = rows.join(model, "member").select("member", F.lit(growth).alias("growth"), "split", F.col("total").alias("actual"), value.alias("predicted"), bends.alias("bends"))
        parts.append(scored)
    both = checkpointed(parts[0].unionByName(parts[1]))
    return mt.bundle(both, ["growth", "split"]).join(both.groupBy("growth").agg(F.avg("bends").alias("mean_bends")), "growth")


# -- small settings of the same fits, which SQL can state -------------------------------------------


@query(
    "M-13 M-16",
    ctes(
        b.PANEL,
        "d AS (SELECT member, ts, total, total - lag(total) OVER o AS w FROM panel WINDOW o AS (PARTITION BY member ORDER BY ts))",
        "l AS (SELECT *, lag(w) OVER (PARTITION BY member ORDER BY ts) AS w1 FROM d)",
        "a AS (SELECT member, regr_intercept(w, w1) AS c0, regr_slope(w, w1) AS c1 FROM l GROUP BY 1)",
        "e AS (SELECT l.*, w - c0 - c1 * w1 AS e FROM l JOIN a USING (member))",
        "x AS (SELECT *, lag(e) OVER (PARTITION BY member ORDER BY ts) AS e1 FROM e)",
        "s AS (SELECT member, sum(w1 * w1) AS p, sum(w1 * e1) AS q, sum(e1 * e1) AS r, sum(w * w1) AS u, sum(w * e1) AS v FROM x WHERE e1 IS NOT NULL GROUP BY 1)",
        "f AS (SELECT member, (u * r - v * q) / (p * r - q * q) AS phi, (p * v - q * u) / (p * r - q * q) AS theta FROM s)",
        "z AS (SELECT member, max_by(total, ts) AS y0, max_by(w, ts) AS w0, max_by(e, ts) AS e0 FROM x GROUP BY 1)",
        "r AS (SELECT member, 1 AS h, phi, theta, phi * w0 + theta * e0 AS w, y0 + phi * w0 + theta * e0 AS y FROM f JOIN z USING (member) "
        "UNION ALL SELECT member, h + 1, phi, theta, phi * w, y + phi * w FROM r WHERE h < 8)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, CAST(h AS BIGINT) AS h, round(phi, 6) AS phi, round(theta, 6) AS theta, round(y, 2) AS predicted FROM r",
)
def one_of_each_arima(spark, sf):
    """Order (1,1,1) whose shocks come from one long lag; eight months ahead."""
    rows = splits.ranked(bd.filled_panel(spark, sf), "member", "ts")
    fits = ar.fit_grid(rows, "member", "ts", "total", F.lit(True), ar.Grid(long_lags=(1,)), extra=8)
    weights = fits.select("member", F.get("beta", 1).alias("phi"), F.get("beta", 2).alias("theta"))
    ahead = ar.predictions(fits, "member").where("rn > train_n").join(weights, "member")
    return ahead.select("member", big(F.col("rn") - F.col("train_n")).alias("h"), rd("phi", 6).alias("phi"), rd("theta", 6).alias("theta"), rd("predicted", 2).alias("predicted"))


@query(
    "M-14 M-17 E-23",
    ctes(
        b.PANEL,
        "d AS (SELECT member, ts, total AS y, lag(total) OVER o AS y1, total - lag(total) OVER o AS w, lag(total) OVER o - lag(total, 2) OVER o AS w1 FROM panel WINDOW o AS (PARTITION BY member ORDER BY ts))",
        "u AS (SELECT * FROM d WHERE w1 IS NOT NULL)",
        "s AS (SELECT member, count(*) AS n, var_pop(y) * count(*) AS a, regr_syy(y, y1) - regr_sxy(y, y1) ** 2 / regr_sxx(y, y1) AS b, sum(w * w) AS c, sum(w * w) - sum(w * w1) ** 2 / sum(w1 * w1) AS e FROM u GROUP BY 1)",
        "o AS (SELECT member, n, 0 AS p, 0 AS d, a AS sse, 1 AS k FROM s UNION ALL SELECT member, n, 1, 0, b, 2 FROM s UNION ALL SELECT member, n, 0, 1, c, 2 FROM s UNION ALL SELECT member, n, 1, 1, e, 3 FROM s)",
    )
    + "SELECT member, p, d, n, round(n * ln(sse / n) + 2 * k, 4) AS aic, round(n * ln(sse / n) + 2 * k + 2.0::DOUBLE * k * (k + 1) / (n - k - 1), 4) AS aicc FROM o",
)
def orders_by_aic(spark, sf):
    """Four orders on one common sample, with their information criteria."""
    rows = splits.ranked(bd.filled_panel(spark, sf), "member", "ts")
    fits = ar.fit_grid(rows, "member", "ts", "total", F.lit(True), ar.Grid(p=(0, 1), d=(0, 1), q=(0,)), common=True)
    return fits.select("member", "p", "d", "n", rd("aic").alias("aic"), rd("aicc").alias("aicc"))


_CRAMER = """
det AS (SELECT member, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS d,
  b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3) AS d1,
  a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13) AS d2,
  a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13) AS d3 FROM g)
"""


@query(
    "M-04",
    ctes(
        b.MEMBER_WIDE,
        "ok AS (SELECT member, ts, proportion AS y, national AS x1, density AS x2, urban AS x3, ts < make_date(" + b.LAST_YEAR + ", 1, 1) AS tr FROM wide WHERE density IS NOT NULL AND urban IS NOT NULL)",
        "m AS (SELECT member, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(x3) AS m3, stddev_pop(x3) AS s3, avg(y) AS my FROM ok WHERE tr GROUP BY 1)",
        "z AS (SELECT member, ts, tr, y - my AS yc, my, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3 FROM ok JOIN m USING (member))",
        "g AS (SELECT member, sum(z1 * z1) AS a11, sum(z1 * z2) AS a12, sum(z1 * z3) AS a13, sum(z2 * z2) AS a22, sum(z2 * z3) AS a23, sum(z3 * z3) AS a33, sum(z1 * yc) AS b1, sum(z2 * yc) AS b2, sum(z3 * yc) AS b3 FROM z WHERE tr GROUP BY 1)",
        _CRAMER,
    )
    + "SELECT member, ts, round(my + (z1 * d1 + z2 * d2 + z3 * d3) / d, 7) AS predicted FROM z JOIN det USING (member)",
)
def three_feature_regression(spark, sf):
    """Least squares of the share on total, density and urban value, fitted on the months before the last complete year."""
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    wide = panel.join(nat, "ts", "left").join(bd.drivers(spark, sf).select("ts", "density", "urban"), "ts", "left")
    rows = checkpointed(ft.proportion(wide, "total", "national").na.drop("any"))
    xs = ["national", "density", "urban"]
    coefs = rg.fit(rows, "member", xs, "proportion", F.col("ts") < F.make_date(bd.last_complete_year(spark, sf), F.lit(1), F.lit(1)))
    return rg.predict(rows, coefs, "member", xs).select("member", "ts", rd("predicted", 7).alias("predicted"))


@query(
    "M-18",
    ctes(
        b.PANEL,
        "num AS (SELECT member, ts, total AS y, row_number() OVER (PARTITION BY member ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY member) AS n FROM panel)",
        "t AS (SELECT *, i / (n - 1)::DOUBLE AS t, greatest(i / (n - 1)::DOUBLE - (floor(n * 0.8::DOUBLE) - 1) / (n - 1)::DOUBLE, 0) AS h FROM num)",
        "g AS (SELECT member, count(*)::DOUBLE AS a11, sum(t) AS a12, sum(h) AS a13, sum(t * t) AS a22, sum(t * h) AS a23, sum(h * h) + 1.25::DOUBLE AS a33, sum(y) AS b1, sum(t * y) AS b2, sum(h * y) AS b3 FROM t GROUP BY 1)",
        _CRAMER,
    )
    + "SELECT member, ts, round((d1 + t * d2 + h * d3) / d, 1) AS predicted FROM t JOIN det USING (member)",
)
def one_bend_trend(spark, sf):
    """Piecewise trend with one changepoint."""
    rows = splits.ranked(bd.filled_panel(spark, sf), "member", "ts")
    model = pw.fit_trend(sm.as_arrays(rows, "member", "ts", "total"), "linear", changepoints=1)
    value = pw.forecast(model, F.col("rn") - 1, "linear")
    return rows.join(model.select("member", "m", "cap", "n_obs"), "member").select("member", "ts", rd(value, 1).alias("predicted"))


@query(
    "M-08 M-09",
    ctes(
        b.PANEL,
        "m AS (SELECT month(ts) AS m, total AS y FROM panel)",
        "c AS (SELECT s, avg(CASE WHEN m <= s THEN y END) AS lo, avg(CASE WHEN m > s THEN y END) AS hi, coalesce(var_pop(CASE WHEN m <= s THEN y END) * count(CASE WHEN m <= s THEN 1 END), 0) + "
        "coalesce(var_pop(CASE WHEN m > s THEN y END) * count(CASE WHEN m > s THEN 1 END), 0) AS sse FROM m, range(1, 12) AS t(s) GROUP BY 1)",
        "best AS (SELECT * FROM c ORDER BY sse LIMIT 1)",
    )
    + "SELECT model, CAST(mo AS BIGINT) AS month, round(CASE WHEN mo <= s THEN lo ELSE hi END, 2) AS predicted FROM best, range(1, 13) AS t(mo), (VALUES ('boosted'), ('forest')) AS k(model)",
)
def one_split_trees(spark, sf):
    """One tree of depth one on the calendar month over all members: its split is the one that leaves the least squared error."""
    rows = checkpointed(bd.filled_panel(spark, sf).select(F.month("ts").cast("double").alias("month"), "total"))
    months = rows.select("month").distinct()
    boosted = bo.fit(rows, ["month"], "total", [bo.Setting(rounds=1, depth=1, step=1.0, leaf_penalty=0.0)])[0]
    forest = te.fit_forest(rows, ["month"], "total", {"numTrees": 1, "maxDepth": 1, "bootstrap": False})
    scored = {"boosted": bo.scored(months, boosted), "forest": te.score(forest, months, ["month"])}
    parts = [df.select(F.lit(n).alias("model"), big("month").alias("month"), rd("predicted", 2).alias("predicted")) for n, df in scored.items()]
    return parts[0].unionByName(parts[1])


@query(
    "M-15",
    ctes(
        b.MEMBER_WIDE,
        "num AS (SELECT member, ts, proportion AS y, national AS x, row_number() OVER (PARTITION BY member ORDER BY ts) AS rn, count(*) OVER (PARTITION BY member) AS n FROM wide)",
        "parts AS (SELECT *, rn <= greatest(24, floor(n * 0.7::DOUBLE)) AS tr FROM num WHERE n >= 48)",
        "co AS (SELECT member, regr_intercept(y, x) AS a, regr_slope(y, x) AS c FROM parts WHERE tr GROUP BY 1)",
        "re AS (SELECT member, ts, rn, tr, y, a + c * x AS f, y - a - c * x AS r FROM parts JOIN co USING (member))",
        "d AS (SELECT *, lag(r) OVER o AS r1, r - lag(r) OVER o AS w, lag(r) OVER o - lag(r, 2) OVER o AS w1 FROM re WINDOW o AS (PARTITION BY member ORDER BY rn))",
        "ph AS (SELECT member, sum(w * w1) / sum(w1 * w1) AS phi FROM d WHERE tr AND w1 IS NOT NULL GROUP BY 1)",
    )
    + "SELECT member, CAST(rn AS BIGINT) AS rn, round(f + r1 + phi * w1, 8) AS predicted FROM d JOIN ph USING (member) WHERE tr AND w1 IS NOT NULL",
)
def regression_with_arima_rest(spark, sf):
    """Share regressed on the total, its remainder by order (1,1,0): one-step values of the train part."""
    panel, total = bd.panel_and_total(spark, sf)
    wide = ft.proportion(panel.join(total.select("ts", F.col("total").alias("national")), "ts", "left"), "total", "national")
    rows = tn.split_rows(wide.select("member", "ts", "national", "proportion"), "member", "ts")
    out = tn.exogenous_candidate(rows, "member", "ts", ["national"], "proportion", ar.Grid(q=(0,)))
    return out.where("split = 'TRAIN'").select("member", big("rn").alias("rn"), rd("predicted", 8).alias("predicted"))


# -- tuning as a whole -----------------------------------------------------------------------------


@query("M-24 M-04 M-11 M-12 M-13 M-14 M-15 F-17")
def member_tuning(spark, sf):
    """Seven models for every member, scored on the same split, best per member, ranked overall."""
    rows = _member_rows(spark, sf)
    parts = [
        tn.linear_candidate(rows, "member", _MEMBER_X, "proportion"),
        tn.seasonal_naive_candidate(rows, "member", "proportion"),
        tn.ets_candidate(rows, "member", "ts", "proportion"),
        tn.theta_candidate(rows, "member", "ts", "proportion"),
        tn.exogenous_candidate(rows, "member", "ts", ["national", "density", "urban"], "proportion", ar.Grid()),
    ]
    scored = [
        tn.arima_candidates(rows, "member", "ts", "proportion", ar.Grid(), "ARIMA"),
        tn.arima_candidates(rows, "member", "ts", "proportion", ar.Grid(sp=(1,), sd=(1,), sq=(1,)), "SARIMA"),
    ]
    return sel.member_leaderboard(tn.candidate_scores(parts, "member", scored), "member")


@query(
    "K-05 E-04 E-19 E-21 J-05 M-01",
    ctes(
        b.PANEL,
        "num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS rn, count(*) OVER (PARTITION BY member) AS n FROM panel)",
        "parts AS (SELECT *, CASE WHEN rn <= greatest(1, least(floor(n * 0.8::DOUBLE), n - 1)) THEN 'TRAIN' ELSE 'TEST' END AS split FROM num)",
        _QUAD,
        "ln AS (SELECT member, regr_intercept(total, rn) AS b0, regr_slope(total, rn) AS b1 FROM parts WHERE split = 'TRAIN' GROUP BY 1)",
        "ev AS (SELECT member, 'QUADRATIC' AS model, total AS a, predicted AS p FROM qp WHERE split = 'TEST' UNION ALL SELECT member, 'LINE', total, b0 + b1 * rn FROM parts JOIN ln USING (member) WHERE split = 'TEST')",
        "rg AS (SELECT member, min(CASE WHEN split = 'TRAIN' THEN ts END) AS train_start, max(CASE WHEN split = 'TRAIN' THEN ts END) AS train_end, min(CASE WHEN split = 'TEST' THEN ts END) AS test_start, max(CASE WHEN split = 'TEST' THEN ts END) AS test_end FROM parts GROUP BY 1)",
        "sc AS (SELECT member, avg(abs(d)) AS scale FROM (SELECT member, total - lag(total) OVER (PARTITION BY member ORDER BY ts) AS d FROM parts WHERE split = 'TRAIN') GROUP BY 1)",
    )
    + "SELECT member, model, round(sqrt(avg((a - p) ** 2)), 2) AS rmse, round(avg(abs((a - p) / a)) * 100, 5) AS mape, round(avg(abs(a - p)) / any_value(scale), 6) AS mase, "
    "round(1 - sum((a - p) ** 2) / (var_pop(a) * count(*)), 5) AS r2, any_value(train_start) AS train_start, any_value(train_end) AS train_end, any_value(test_start) AS test_start, any_value(test_end) AS test_end "
    "FROM ev JOIN rg USING (member) JOIN sc USING (member) GROUP BY 1, 2",
)
def common_split_evaluation(spark, sf):
    """Two trend models on the same chronological split of every member."""
    rows = checkpointed(splits.two_way(bd.filled_panel(spark, sf), "member", "ts", 0.8))

    def quadratic(df):
        return tr.predict_quadratic(df, tr.quadratic_trend(df, "member", "rn", "total", _is_train()), "member", "rn")

    def line(df):
        return tr.predict_line(df, tr.linear_trend(df, "member", "rn", "total", _is_train()), "member", "rn")

    out = tn.evaluate(rows, "member", "ts", "total", {"QUADRATIC": quadratic, "LINE": line})
    return out.select(
        "member", "model", rd("rmse", 2).alias("rmse"), rd("mape", 5).alias("mape"), rd("mase", 6).alias("mase"), rd("r2", 5).alias("r2"),
        "train_start", "train_end", "test_start", "test_end",
    )


@query("M-24 M-05 M-08 M-09 M-13 M-14 M-15 E-11")
def total_tuning(spark, sf):
    """Every model family on the total series: best setting of each family by validation error, ranked."""
    rows = tn.split_rows(bd.national_master(spark, sf), "member", "ts")
    parts = [
        tn.linear_candidate(rows, "member", _NATIONAL_X, "total"),
        *tn.tree_candidates(rows, "member", _NATIONAL_X, "total"),
        tn.exogenous_candidate(rows, "member", "ts", bd.DRIVERS, "total", ar.Grid()),
    ]
    scored = [
        tn.arima_candidates(rows, "member", "ts", "total", ar.Grid(), "ARIMA"),
        tn.arima_candidates(rows, "member", "ts", "total", ar.seasonal_grid(), "SARIMA"),
    ]
    return sel.best_per_family(tn.candidate_scores(parts, "member", scored))


# -- allocation, prediction, demand, serving -------------------------------------------------------

_SHARE_LINE = """
w AS (SELECT ts, total, density, urban FROM nat JOIN drv USING (ts)),
lastw AS (SELECT max(ts) AS lts, max_by(total, ts) AS lt, max_by(density, ts) AS ld, max_by(urban / total, ts) AS lu FROM w),
co AS (SELECT member, regr_intercept(proportion, fy) AS b0, regr_slope(proportion, fy) AS b1 FROM (SELECT member, proportion, year(ts) + (month(ts) - 1) / 12.0::DOUBLE AS fy FROM wide) GROUP BY 1),
fut AS (SELECT member, b0, b1, CAST(unnest(generate_series((SELECT max(ts) FROM w) + INTERVAL 1 MONTH, (SELECT max(ts) FROM w) + INTERVAL 24 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ts FROM co),
al AS (SELECT member, ts, lt * (1 + 0.008::DOUBLE * ((ts - lts) / 30.44::DOUBLE)) AS national, ld AS density, lu * (lt * (1 + 0.008::DOUBLE * ((ts - lts) / 30.44::DOUBLE))) AS urban,
  b0 + b1 * (year(ts) + (month(ts) - 1) / 12.0::DOUBLE) AS share FROM fut, lastw)
"""


def _allocation(spark, sf):
    panel, total = bd.panel_and_total(spark, sf)
    nat = checkpointed(total.join(bd.drivers(spark, sf).select("ts", "density", "urban"), "ts"))
    shares = ft.proportion(
        panel.join(nat.select("ts", F.col("total").alias("grand")), "ts", "left"), "total", "grand"
    ).withColumn("fy", tm.fractional_year(F.col("ts")))
    coefs = tr.linear_trend(shares, "member", "fy", "proportion", F.lit(True))
    return fc.allocate(coefs, "member", nat)


@query(
    "M-26 J-08 I-17 I-18 I-19 I-26 I-27",
    ctes(b.MEMBER_WIDE, _SHARE_LINE)
    + "SELECT member, ts, round_even(share, 6) AS predicted_proportion, CAST(round(share * national / 1000, 0) AS BIGINT) AS predicted_thousands, round(national, 2) AS national, round(density, 6) AS density, round(urban, 2) AS urban FROM al",
)
def member_allocation(spark, sf):
    out = _allocation(spark, sf)
    return out.select(
        "member", "ts", "predicted_proportion", big(F.round(F.col("predicted_member") / 1000, 0)).alias("predicted_thousands"),
        rd("national", 2).alias("national"), rd("density", 6).alias("density"), rd("urban", 2).alias("urban"),
    )


# Yearly kilograms per head of the staple items.
_RATES = {"rice": 100.0, "maize": 12.0, "lentils": 6.0, "onions": 9.5, "potatoes": 7.0}


@query(
    "B-19 M-26",
    ctes(b.NATIONAL, "r(item, rate) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _RATES.items()) + ")")
    + "SELECT ts, item, rate, round(total * rate, 4) AS demand FROM nat, r",
)
def item_demand(spark, sf):
    out = fc.demand(bd.national(spark, sf).select("ts", "total"), "total", _RATES)
    return out.select("ts", "item", "rate", rd("demand", 4).alias("demand"))


@query(
    "M-20 F-09 F-06",
    ctes(
        b.YEARLY,
        "lt AS (SELECT member, regr_intercept(total, year) AS b0, regr_slope(total, year) AS b1 FROM yearly GROUP BY 1)",
        "pts AS (SELECT member, year, total FROM yearly WHERE year = (SELECT max(year) FROM yearly) UNION ALL SELECT member, CAST(ly + h AS INT), b0 + b1 * (ly + h) FROM lt, (SELECT max(year) AS ly FROM yearly), range(1, 4) AS t(h))",
        "cells AS (SELECT member, CAST(make_date(year, 12, 1) AS DATE) AS ts, total FROM pts)",
        "grid AS (SELECT member, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS DATE) AS ts FROM cells GROUP BY 1)",
        "gaps AS (SELECT member, ts, total FROM grid LEFT JOIN cells USING (member, ts))",
        b.interpolated("panel", "gaps", edge="forward"),
    )
    + "SELECT member, ts, round(total, 0) AS predicted FROM panel WHERE ts >= make_date((SELECT max(year) FROM yearly) + 1, 1, 31)",
)
def linear_months_between_forecasts(spark, sf):
    """Yearly line forecasts joined to the last actual year and interpolated to months after the cutoff."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    coefs = tr.linear_trend(yearly, "member", "year", "total", F.lit(True))
    last = yearly.groupBy("member").agg(F.max("year").alias("last_year"), F.max_by("total", "year").alias("total"))
    ahead = tr.predict_line(cal.year_horizon(last.select("member", "last_year"), "last_year", 3), coefs, "member", "year", "total")
    anchors = last.select("member", F.col("last_year").alias("year"), "total").unionByName(ahead.select("member", "year", "total"))
    cells = anchors.select("member", tm.month_start(tm.year_end(F.col("year"))).alias("ts"), "total")
    monthly = fill.interpolate(cal.regularise(cells, "member", shared_range=False), "member", "ts", ["total"], edge="forward")
    return cal.after_last_year(monthly, one_value(yearly, F.max("year"))).select("member", "ts", rd("total", 0).alias("predicted"))


_BATCH = """
req AS (SELECT DISTINCT n_name AS member, CAST(o_orderdate AS DATE) AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
nl AS (SELECT regr_intercept(total, year) AS b0, regr_slope(total, year) AS b1 FROM ynat),
sl AS (SELECT member, regr_intercept(proportion, year) AS i1, regr_slope(proportion, year) AS s1 FROM sh GROUP BY 1),
bk AS (SELECT r.member, r.ts, coalesce((SELECT max_by(total, year) FROM ynat WHERE year <= year(r.ts)), (SELECT min_by(total, year) FROM ynat)) AS held FROM req r),
p AS (SELECT member, ts, b0 + b1 * (year(ts) + (month(ts) - 1) / 12.0::DOUBLE) AS line, held, i1 + s1 * (year(ts) + (month(ts) - 1) / 12.0::DOUBLE) AS share FROM bk JOIN sl USING (member), nl)
"""


@query(
    "M-27 E-24 J-07 J-16 I-20",
    ctes(b.YEARLY, b.YEARLY_NATIONAL, _SHARES, _BATCH)
    + "SELECT member, ts, round(line, 0) AS national_line, held AS national_held, round((line + held) / 2, 0) AS ensemble, round(share, 6) AS proportion, round(share * (line + held) / 2, 0) AS member_value FROM p",
)
def batch_predictions(spark, sf):
    """Every distinct (member, order date) as a request: two total models, their mean, the member share and value."""
    orders = bd.table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ts")).distinct()
    requests = checkpointed(
        orders.join(bd.customer_members(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("member", "ts").distinct()
    )
    shares_by_year = _shares(spark, sf)
    yearly = bd.total_of(shares_by_year, "year").select("member", F.make_date("year", F.lit(1), F.lit(1)).alias("ts"), "total", "year")
    dates = requests.select(F.lit("TOTAL").alias("member"), "ts").distinct()
    line = tr.linear_trend(yearly, "member", "year", "total", F.lit(True))
    totals = {
        "line": tr.predict_line(dates.withColumn("fy", tm.fractional_year(F.col("ts"))), line, "member", "fy").select("ts", "predicted"),
        "held": joins.asof_backward(dates, yearly, "member", "ts", ["total"]).select("ts", F.col("total").alias("predicted")),
    }
    shares = tr.linear_trend(shares_by_year, "member", "year", "proportion", F.lit(True))
    out = fc.predict_requests(requests, totals, shares)
    return out.select(
        "member", "ts", rd("total_line", 0).alias("national_line"), F.col("total_held").alias("national_held"), rd("ensemble", 0).alias("ensemble"),
        rd("proportion", 6).alias("proportion"), rd("member_value", 0).alias("member_value"),
    )


@query(
    "M-27 M-04 J-07 E-24 J-16",
    ctes(
        b.MEMBER_WIDE,
        "ok AS (SELECT member, ts, proportion AS y, national AS x1, density AS x2, urban AS x3, TRUE AS tr FROM wide WHERE density IS NOT NULL AND urban IS NOT NULL AND national IS NOT NULL)",
        "m AS (SELECT member, avg(x1) AS m1, stddev_pop(x1) AS s1, avg(x2) AS m2, stddev_pop(x2) AS s2, avg(x3) AS m3, stddev_pop(x3) AS s3, avg(y) AS my FROM ok GROUP BY 1)",
        "z AS (SELECT member, y - my AS yc, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, (x3 - m3) / s3 AS z3 FROM ok JOIN m USING (member))",
        "g AS (SELECT member, sum(z1 * z1) AS a11, sum(z1 * z2) AS a12, sum(z1 * z3) AS a13, sum(z2 * z2) AS a22, sum(z2 * z3) AS a23, sum(z3 * z3) AS a33, sum(z1 * yc) AS b1, sum(z2 * yc) AS b2, sum(z3 * yc) AS b3 FROM z GROUP BY 1)",
        _CRAMER,
        "req AS (SELECT DISTINCT n_name AS member, CAST(o_orderdate AS DATE) AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
        "w AS (SELECT n.ts, n.total AS national, d.density, d.urban FROM nat n JOIN drv d USING (ts))",
        "asof_day AS (SELECT ts, coalesce((SELECT max(w.ts) FROM w WHERE w.ts <= r.ts), (SELECT min(w.ts) FROM w)) AS m FROM (SELECT DISTINCT ts FROM req) r)",
        "ln AS (SELECT regr_intercept(national, epoch(CAST(ts AS TIMESTAMP)) / 86400) AS b0, regr_slope(national, epoch(CAST(ts AS TIMESTAMP)) / 86400) AS b1 FROM w)",
        "v AS (SELECT a.ts, w.national, w.density, w.urban, b0 + b1 * (epoch(CAST(a.ts AS TIMESTAMP)) / 86400) AS line FROM asof_day a JOIN w ON w.ts = a.m, ln)",
    )
    + "SELECT r.member, r.ts, round(line, 0) AS total_line, round(v.national, 0) AS total_held, round((line + v.national) / 2, 0) AS ensemble, "
    "round(my + ((v.national - m1) / s1 * d1 + (v.density - m2) / s2 * d2 + (v.urban - m3) / s3 * d3) / d, 6) AS proportion FROM req r JOIN v ON v.ts = r.ts JOIN m ON m.member = r.member JOIN det ON det.member = r.member",
)
def driver_share_predictions(spark, sf):
    """Every distinct (member, order date): two models of the total, their mean, and the share regressed on total, density and urban value as of that date."""
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    drivers = bd.drivers(spark, sf).select("ts", "density", "urban")
    known = checkpointed(nat.join(drivers, "ts").withColumns({"member": F.lit("TOTAL"), "day": F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("double")}))
    rows = checkpointed(ft.proportion(panel.join(known.drop("member", "day"), "ts"), "total", "national").na.drop("any"))
    xs = ["national", "density", "urban"]
    shares = rg.fit(rows, "member", xs, "proportion", F.lit(True))
    orders = bd.table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("ts")).distinct()
    requests = checkpointed(orders.join(bd.customer_members(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("member", "ts").distinct())
    dates = requests.select(F.lit("TOTAL").alias("member"), "ts").distinct()
    held = joins.asof_backward(dates, known, "member", "ts", xs).withColumn("day", F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("double"))
    line = tr.linear_trend(known, "member", "day", "national", F.lit(True))
    models = tr.predict_line(held, line, "member", "day", "total_line").withColumn("total_held", F.col("national")).drop("member", "day", "matched_ts")
    long = models.select("ts", F.explode(F.array(F.struct(F.col("total_line").alias("predicted")), F.struct(F.col("total_held").alias("predicted")))).alias("p")).select("ts", "p.predicted")
    mean = fc.ensemble(long, ["ts"]).select("ts", "ensemble")
    out = rg.predict(requests.join(models.join(mean, "ts"), "ts"), shares, "member", xs, "proportion")
    return out.select("member", "ts", *[rd(c, 0).alias(c) for c in ("total_line", "total_held", "ensemble")], rd("proportion", 6).alias("proportion"))


_REGISTERED = ["linear", "piecewise", "trees", "arima"]


@query("M-27 A-14 M-04 M-08 M-13 M-18 E-24 J-07")
def registered_predictions(spark, sf):
    """Every distinct (member, order date): the total by four fitted models from the versioned model store, their mean, and the member's share of it by its line.

    Drivers are those of the last month at or before the date. Every fourth customer asks three years later, beyond the data.
    """
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    known = checkpointed(
        nat.join(bd.drivers(spark, sf), "ts").select(F.lit("TOTAL").alias("member"), "ts", "national", *bd.DRIVERS, tm.fractional_year(F.col("ts")).alias("fractional_year"), tm.month_sin(F.col("ts")).alias("month_sin"), tm.month_cos(F.col("ts")).alias("month_cos"))
    )
    xs = ["fractional_year", "month_sin", "month_cos", "density", "urban"]
    rows = checkpointed(splits.two_way(known, "member", "ts", 0.85).withColumn("watched", F.col("split") == "TEST"))
    arrays = checkpointed(sm.as_arrays(known, "member", "ts", "national"))
    first, last = rgy.month_number(F.element_at("tss", 1)), rgy.month_number(F.element_at("tss", -1))
    order = ar.fit_grid(rows, "member", "ts", "national", F.lit(True), ar.Grid(), method="css")
    models = rgy.linear_models(rg.fit(rows, "member", xs, "national", F.lit(True)), "member", xs)
    models = models.unionByName(rgy.piecewise_models(pw.fit_trend(arrays), "member", first))
    models = models.unionByName(rgy.tree_model(spark, bo.fit(rows, xs, "national", [te.BOOSTED_GRID[1]], "watched")[0], "TOTAL"))
    models = models.unionByName(rgy.arima_models(order, arrays.select("member", "ys", last.alias("last_month")), "member", F.col("last_month"), 12))
    store = sinks.KeyedStore(spark, scratch_path(spark, "models"), ["name", "member"])
    store.put(models)
    later = F.when(F.col("o_custkey") % 4 == 0, 36).otherwise(0)
    orders = bd.table(spark, sf, "orders").select("o_custkey", F.add_months(F.to_date("o_orderdate"), later).alias("ts")).distinct()
    requests = checkpointed(orders.join(bd.customer_members(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select("member", "ts").distinct())
    dates = requests.select(F.lit("TOTAL").alias("member"), "ts").distinct()
    asked = joins.asof_backward(dates, known, "member", "ts", ["density", "urban"])
    asked = checkpointed(asked.withColumns({"month": rgy.month_number(F.col("ts")).cast("long"), "fractional_year": tm.fractional_year(F.col("ts")), "month_sin": tm.month_sin(F.col("ts")), "month_cos": tm.month_cos(F.col("ts"))}))
    scored = rgy.wide(rgy.score(store.read(), asked, xs), _REGISTERED, ["month"])
    shares = ft.proportion(panel.join(nat, "ts"), "total", "national").withColumn("fy", tm.fractional_year(F.col("ts")))
    lines = tr.linear_trend(shares, "member", "fy", "proportion", F.lit(True)).select("member", "intercept", "slope")
    out = requests.withColumn("month", rgy.month_number(F.col("ts")).cast("long")).join(scored, "month").join(lines, "member")
    share = F.col("intercept") + F.col("slope") * tm.fractional_year(F.col("ts"))
    return out.select("member", "ts", *_REGISTERED, "n_models", "ensemble", share.alias("proportion"), (share * F.col("ensemble")).alias("member_value"))


@query(
    "M-28 J-11 C-15",
    ctes(
        "fcst AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1)",
        "req AS (SELECT o_orderkey, CAST(o_orderdate + CASE WHEN o_orderkey % 4 = 0 THEN INTERVAL 5 YEAR ELSE INTERVAL 0 YEAR END AS DATE) AS d FROM orders)",
    )
    + "SELECT o_orderkey, d AS date_requested, v AS predicted_value, CASE WHEN v IS NULL THEN 'not_found' ELSE 'found' END AS status FROM req LEFT JOIN fcst ON year(d) = year(ts) AND month(d) = month(ts)",
)
def national_lookup(spark, sf):
    """Order dates, every fourth five years later, looked up in the monthly table of shipped value."""
    shipped = bd.table(spark, sf, "lineitem").select("l_shipdate", "l_extendedprice")
    forecast = shipped.groupBy(tm.month_start(F.col("l_shipdate")).alias("ts")).agg(bd.money("l_extendedprice").alias("v"))
    later = F.when(F.col("o_orderkey") % 4 == 0, 60).otherwise(0)
    requests = bd.table(spark, sf, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), later).alias("date_requested"))
    out = fc.lookup_national(requests, forecast, "date_requested", "ts", "v")
    return out.select("o_orderkey", "date_requested", "predicted_value", "status")


@query(
    "M-28 J-10 J-11 C-03",
    ctes(
        b.CELLS,
        "hist AS (SELECT * FROM cells)",
        "fcst AS (SELECT member, CAST(ts + INTERVAL 12 MONTH AS DATE) AS ts, total FROM cells WHERE ts > (SELECT max(ts) FROM cells) - INTERVAL 24 MONTH)",
        "req AS (SELECT DISTINCT upper(n_name) AS member, CAST(o_orderdate + CASE WHEN o_orderkey % 4 = 0 THEN INTERVAL 18 MONTH ELSE INTERVAL 0 MONTH END AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
    )
    + "SELECT r.member, d, coalesce(f.total, h.total) AS predicted_value, CASE WHEN f.total IS NOT NULL THEN 'forecast' WHEN h.total IS NOT NULL THEN 'historical_actual' END AS value_type, "
    "CASE WHEN coalesce(f.total, h.total) IS NULL THEN 'not_found' ELSE 'found' END AS status FROM req r "
    "LEFT JOIN fcst f ON upper(f.member) = r.member AND f.ts = date_trunc('month', d) LEFT JOIN hist h ON upper(h.member) = r.member AND h.ts = date_trunc('month', d)",
)
def member_lookup(spark, sf):
    """Upper-case member names and order dates, every fourth 18 months later: forecast first, then history, else not found.

    The forecast repeats the last two years, one year later.
    """
    cells = checkpointed(bd.member_cells(spark, sf))
    history = cells.withColumnRenamed("total", "population")
    forecast = cells.where(F.col("ts") > F.add_months(one_value(cells, F.max("ts")), -24)).select("member", F.add_months("ts", 12).alias("ts"), "total")
    named = bd.customer_members(spark, sf).withColumn("member", F.upper("member"))
    later = F.when(F.col("o_orderkey") % 4 == 0, 18).otherwise(0)
    orders = bd.table(spark, sf, "orders").select("o_custkey", F.add_months(F.to_date("o_orderdate"), later).alias("d")).distinct()
    requests = orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select("member", "d").distinct()
    out = fc.lookup_member(requests, forecast, history, "member", "d", "ts", "total", "population")
    return out.select("member", "d", "predicted_value", "value_type", "status")
