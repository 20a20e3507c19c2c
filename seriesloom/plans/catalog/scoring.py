"""Error measures, leaderboards, selection and back-test summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.operators import backtest as bt
from seriesloom.operators import forecasting as fc
from seriesloom.operators import metrics as mt
from seriesloom.operators import ranking
from seriesloom.operators import selection as sel
from seriesloom.operators import smoothing as sm
from seriesloom.operators.keys import one_value
from seriesloom.plans import bindings as bd
from seriesloom.plans.catalog import base as b
from seriesloom.plans.catalog.base import big, ctes, query, rd
from seriesloom.session import checkpointed


@query(
    "E-15 E-17 E-18 E-21",
    ctes(b.METRICS)
    + "SELECT member, model, split, n_rows, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 6) AS mape, round(r2, 6) AS r2 FROM mets",
)
def error_measures(spark, sf):
    m = b.metrics(spark, sf)
    return m.select("member", "model", "split", "n_rows", rd("rmse").alias("rmse"), rd("mae").alias("mae"), rd("mape", 6).alias("mape"), rd("r2", 6).alias("r2"))


@query(
    "E-18",
    ctes(b.PREDICTIONS)
    + "SELECT member, model, avg(CASE WHEN a = 0 THEN 'Infinity'::DOUBLE ELSE round(abs((a - predicted) / a) * 100, 6) END) = 'Infinity'::DOUBLE AS infinite, "
    "round(avg(CASE WHEN a <> 0 THEN abs((a - predicted) / a) END) * 100, 5) AS mape_without_zeros FROM "
    "(SELECT *, CASE WHEN model = 'NAIVE' AND rn = 7 THEN 0 ELSE actual END AS a FROM preds WHERE predicted IS NOT NULL) GROUP BY 1, 2",
)
def percentage_error_at_zero(spark, sf):
    """One actual of the naive model is set to 0: infinite without a guard, left out with one."""
    preds = b.predictions(spark, sf).where("predicted IS NOT NULL")
    actual = F.when((F.col("model") == "NAIVE") & (F.col("rn") == 7), 0.0).otherwise(F.col("actual"))
    errors = [mt.mape(actual, F.col("predicted"), zero).alias(zero) for zero in ("unguarded", "skip")]
    out = preds.groupBy("member", "model").agg(*errors)
    return out.select("member", "model", (F.col("unguarded") == F.lit(float("inf"))).alias("infinite"), rd("skip", 5).alias("mape_without_zeros"))


@query(
    "E-02 E-01",
    ctes(b.CELLS, b.GAPS)
    + "SELECT CASE WHEN total IS NULL THEN NULL ELSE CAST(year(ts) AS BIGINT) END AS year, count(*) AS n_rows, round(avg(total), 4) AS mean_total FROM gaps GROUP BY 1",
)
def means_with_null_group(spark, sf):
    """Months without orders form the NULL group."""
    panel = bd.member_panel(spark, sf)
    year = F.when(F.col("total").isNotNull(), big(F.year("ts")))
    return panel.groupBy(year.alias("year")).agg(F.count(F.lit(1)).alias("n_rows"), rd(F.avg("total")).alias("mean_total"))


@query(
    "E-16 I-24",
    ctes(b.PREDICTIONS)
    + "SELECT member, model, CASE WHEN model = 'TREND' THEN 'Infinity'::DOUBLE ELSE round(sqrt(avg((actual - predicted) ** 2)), 4) END AS rmse FROM preds GROUP BY 1, 2",
)
def exploded_forecasts(spark, sf):
    """The line forecasts of the last month are blown up, so their error counts as infinite."""
    preds = b.predictions(spark, sf)
    huge = F.when((F.col("model") == "TREND") & (F.col("rn") == F.col("last")), F.lit(1e200)).otherwise(F.col("predicted"))
    last = preds.groupBy("member").agg(F.max("rn").alias("last"))
    out = preds.join(last, "member").withColumn("predicted", huge)
    value = mt.rmse_guarded(F.col("actual"), F.col("predicted"))
    return out.groupBy("member", "model").agg(value.alias("v")).select(
        "member", "model", F.when(F.col("v") < F.lit(float("inf")), rd("v")).otherwise(F.col("v")).alias("rmse")
    )


@query(
    "E-19",
    ctes(
        b.METRICS,
        "sc AS (SELECT member, avg(abs(d1)) AS s1, avg(abs(d12)) AS s12 FROM (SELECT member, total - lag(total) OVER w AS d1, total - lag(total, 12) OVER w AS d12 FROM parts WHERE split = 'TRAIN' WINDOW w AS (PARTITION BY member ORDER BY ts)) GROUP BY 1)",
    )
    + "SELECT member, model, round(mae / s1, 6) AS mase, round(mae / s12, 6) AS seasonal_mase FROM mets JOIN sc USING (member) WHERE split = 'TEST'",
)
def scaled_errors(spark, sf):
    preds = b.predictions(spark, sf)
    test = mt.bundle(preds.where("split = 'TEST'"), ["member", "model"]).select("member", "model", "mae")
    train = preds.where("split = 'TRAIN' AND model = 'TREND'")
    one = mt.with_mase(test, mt.naive_scale(train, "member", "ts", "actual", 1), "member")
    both = one.withColumnRenamed("mase", "m1").join(mt.naive_scale(train, "member", "ts", "actual", 12), "member")
    return both.select("member", "model", rd("m1", 6).alias("mase"), rd(mt.mase(F.col("mae"), F.col("scale")), 6).alias("seasonal_mase"))


_CAND_COLS = [f"{s}_{m}" for s in ("train", "val", "test") for m in ("rmse", "mae", "mape")]


@query("E-22", ctes(b.CANDIDATES) + "SELECT member, model, " + ", ".join(f"round({c}, 4) AS {c}" for c in _CAND_COLS) + " FROM cand")
def split_errors(spark, sf):
    return b.candidates(spark, sf).select("member", "model", *[rd(c).alias(c) for c in _CAND_COLS])


@query(
    "E-23",
    ctes(
        b.PREDICTIONS,
        "s AS (SELECT member, model, count(*) AS n, sum((actual - predicted) ** 2) AS sse, CASE WHEN model = 'NAIVE' THEN 1 ELSE 2 END AS k FROM preds WHERE split = 'TRAIN' AND predicted IS NOT NULL GROUP BY 1, 2)",
    )
    + "SELECT member, model, round(n * ln(sse / n) + 2 * k, 4) AS aic, round(n * ln(sse / n) + 2 * k + (2 * k * (k + 1)) / (n - k - 1), 4) AS aicc FROM s",
)
def information_criteria(spark, sf):
    preds = b.predictions(spark, sf).where("split = 'TRAIN' AND predicted IS NOT NULL")
    err = F.col("actual") - F.col("predicted")
    s = preds.groupBy("member", "model").agg(F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("sse"))
    k = F.when(F.col("model") == "NAIVE", 1).otherwise(2)
    aic = F.col("n") * F.log(F.col("sse") / F.col("n")) + 2 * k
    return s.select("member", "model", rd(aic).alias("aic"), rd(nm.aicc(aic, F.col("n"), k)).alias("aicc"))


@query(
    "E-08 E-09 M-22 K-03",
    ctes(
        b.METRICS,
        "p AS (SELECT member, model, avg(CASE WHEN split = 'TRAIN' THEN mape END) AS tr, avg(CASE WHEN split = 'VAL' THEN mape END) AS va, avg(CASE WHEN split = 'TEST' THEN mape END) AS te FROM mets GROUP BY 1, 2)",
    )
    + "SELECT member, model, round(tr, 4) AS \"TRAIN\", round(va, 4) AS \"VAL\", round(te, 4) AS \"TEST\", round(va / nullif(tr, 0), 4) AS overfitting_ratio, "
    "CASE WHEN tr > 5 THEN 'Underfitting (High Bias)' WHEN va / nullif(tr, 0) > 5 THEN 'Overfitting (High Variance)' ELSE 'Good Fit' END AS status, "
    "CASE WHEN va / greatest(tr, 0.01) < 5 THEN 'OK' WHEN va / greatest(tr, 0.01) < 10 THEN 'Check' ELSE 'Overfitting' END AS level FROM p",
)
def fit_diagnosis(spark, sf):
    out = sel.diagnose(b.metrics(spark, sf), ["member", "model"])
    return out.select("member", "model", *[rd(c).alias(c) for c in ("TRAIN", "VAL", "TEST", "overfitting_ratio")], "status", "level")


@query(
    "M-23 G-03",
    ctes(b.METRICS)
    + "SELECT model, round(avg(CASE WHEN split = 'TEST' THEN mape END) - avg(CASE WHEN split = 'VAL' THEN mape END), 4) AS gap FROM mets GROUP BY 1 ORDER BY gap DESC",
)
def generalisation_gap(spark, sf):
    out = sel.generalisation_gap(b.metrics(spark, sf), ["model"])
    return out.orderBy(F.desc("gap")).select("model", rd("gap").alias("gap"))


@query(
    "E-10",
    ctes(b.METRICS, "r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY 100 - mape DESC, model) AS k FROM mets WHERE split = 'TEST')")
    + "SELECT member, model, round(100 - mape, 4) AS accuracy FROM r WHERE k = 1",
)
def best_model_row(spark, sf):
    test = b.metrics(spark, sf).where("split = 'TEST'").withColumn("accuracy", nm.accuracy(F.col("mape")))
    best = ranking.first_per_group(test, "member", F.struct((-F.col("accuracy")).alias("a"), "model"))
    return best.select("member", "model", rd("accuracy").alias("accuracy"))


@query(
    "E-12 E-27",
    ctes(b.METRICS, "t AS (SELECT member, max(100 - mape) AS acc FROM mets WHERE split = 'TEST' GROUP BY 1)")
    + "SELECT count(DISTINCT member) AS members, round(max(acc), 4) AS best, round(min(acc), 4) AS worst, round(avg(acc), 4) AS average, round(median(acc), 4) AS median FROM t",
)
def accuracy_summary(spark, sf):
    """The median goes by global rank, so it holds for any number of members."""
    acc = b.metrics(spark, sf).where("split = 'TEST'").groupBy("member").agg(F.max(nm.accuracy(F.col("mape"))).alias("acc"))
    median = ranking.exact_median(acc, "acc").select(rd("median").alias("v")).scalar()
    stats = acc.agg(
        F.count_distinct("member").alias("members"), rd(F.max("acc")).alias("best"), rd(F.min("acc")).alias("worst"), rd(F.avg("acc")).alias("average")
    )
    return stats.withColumn("median", median)


@query(
    "E-24",
    ctes(b.PREDICTIONS)
    + "SELECT member, ts, round(avg(predicted), 2) AS ensemble, count(predicted) AS n_models FROM preds GROUP BY 1, 2",
)
def ensemble_mean(spark, sf):
    out = fc.ensemble(b.predictions(spark, sf), ["member", "ts"])
    return out.select("member", "ts", rd("ensemble", 2).alias("ensemble"), "n_models")


@query(
    "E-25",
    ctes(b.CELLS, b.NATIONAL)
    + "SELECT member, round(sum(total), 2) AS total FROM cells GROUP BY 1 UNION ALL SELECT NULL, round((SELECT sum(total) FROM nat), 2)",
)
def grand_total(spark, sf):
    cells = bd.member_cells(spark, sf)
    return cells.rollup("member").agg(rd(F.sum("total"), 2).alias("total"))


@query(
    "F-19 M-21 K-02",
    ctes(b.CANDIDATES)
    + "SELECT member, model, round(val_train_ratio, 6) AS val_train_ratio, round(selection_score, 6) AS selection_score FROM scored",
)
def selection_scores(spark, sf):
    out = sel.with_selection(b.candidates(spark, sf))
    return out.select("member", "model", rd("val_train_ratio", 6).alias("val_train_ratio"), rd("selection_score", 6).alias("selection_score"))


@query(
    "M-24 F-14 G-02",
    ctes(
        b.CANDIDATES,
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY selection_score, val_rmse, test_rmse, model) AS k FROM scored) WHERE k = 1)",
    )
    + "SELECT member, model, round(selection_score, 6) AS selection_score, round(test_mape, 4) AS test_mape, 1 AS rank_by_val, row_number() OVER (ORDER BY selection_score, val_rmse, test_rmse, member) AS overall_rank_by_val FROM best",
)
def member_leaderboard(spark, sf):
    out = sel.member_leaderboard(b.candidates(spark, sf), "member")
    return out.select("member", "model", rd("selection_score", 6).alias("selection_score"), rd("test_mape").alias("test_mape"), "rank_by_val", "overall_rank_by_val")


@query(
    "M-24 G-02",
    ctes(
        b.CANDIDATES,
        "broken AS (SELECT member, model, train_mape, test_rmse, test_mape, CASE WHEN member = (SELECT min(member) FROM cand) OR model = 'NAIVE' THEN NULL ELSE val_mape END AS val_mape, "
        "CASE WHEN member = (SELECT min(member) FROM cand) OR model = 'NAIVE' THEN NULL ELSE val_rmse END AS val_rmse FROM cand)",
        "rated AS (SELECT *, coalesce(val_mape * (1 + 0.5 * greatest(0, val_mape / greatest(train_mape, 0.5) - 1)), 'Infinity'::DOUBLE) AS score, coalesce(val_rmse, 'Infinity'::DOUBLE) AS vr FROM broken)",
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member ORDER BY score, vr, test_rmse, model) AS k FROM rated) WHERE k = 1)",
    )
    + "SELECT member, model, round(val_mape, 4) AS val_mape, row_number() OVER (ORDER BY score, vr, test_rmse, member) AS overall_rank_by_val FROM best",
)
def failed_candidates_last(spark, sf):
    """One model, and all models of the first member, failed on the validation rows: they come after all that did not."""
    cand = checkpointed(b.candidates(spark, sf))
    failed = (F.col("member") == one_value(cand, F.min("member"))) | (F.col("model") == "NAIVE")
    broken = cand.withColumns({c: F.when(~failed, F.col(c)) for c in ("val_mape", "val_rmse")})
    return sel.member_leaderboard(broken, "member").select("member", "model", rd("val_mape").alias("val_mape"), "overall_rank_by_val")


@query(
    "M-24 E-11 F-14",
    ctes(
        b.CANDIDATES,
        "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY selection_score, val_rmse, test_rmse, member) AS k FROM scored) WHERE k = 1)",
    )
    + "SELECT model, member AS params, round(selection_score, 6) AS selection_score, row_number() OVER (ORDER BY selection_score, val_rmse, model) AS rank_by_val FROM best",
)
def family_leaderboard(spark, sf):
    """Members stand for parameter settings: the best setting of each model family, ranked."""
    cand = b.candidates(spark, sf).drop("params").withColumnRenamed("member", "params")
    out = sel.best_per_family(cand)
    return out.select("model", "params", rd("selection_score", 6).alias("selection_score"), "rank_by_val")


# -- back-test -------------------------------------------------------------------------------------

_LINE_FOLDS = """
num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i FROM panel),
fits AS (SELECT f.member, f.i, avg(p.total) AS my, avg(p.i) AS mx, regr_sxy(p.total, p.i) / regr_sxx(p.total, p.i) AS b1
  FROM num f JOIN num p ON p.member = f.member AND p.i < f.i WHERE f.i > 24 GROUP BY 1, 2),
lines AS (SELECT *, lag(total) OVER w AS prev, lag(total, 12) OVER w AS prev12 FROM num WINDOW w AS (PARTITION BY member ORDER BY i)),
folds AS (SELECT member, ts AS fold, 'NAIVE' AS pipeline, total AS actual, prev AS predicted FROM lines WHERE i > 24
  UNION ALL SELECT member, ts, 'SEASONAL', total, prev12 FROM lines WHERE i > 24
  UNION ALL SELECT member, ts, 'TREND', total, my + b1 * (i - mx) FROM lines JOIN fits USING (member, i)
  UNION ALL SELECT f.member, f.ts, 'REGRESSION', any_value(f.total), avg(p.total) + regr_sxy(p.total, p.prev) / regr_sxx(p.total, p.prev) * (any_value(f.prev) - avg(p.prev))
    FROM lines f JOIN lines p ON p.member = f.member AND p.i < f.i AND p.prev IS NOT NULL WHERE f.i > 24 GROUP BY 1, 2)
"""

_EVALUATORS = {"NAIVE": bt.naive, "SEASONAL": bt.seasonal(12), "TREND": bt.line, "REGRESSION": bt.lag_line}


@query(
    "M-25 J-14 F-18 K-05 B-20",
    ctes(b.PANEL, _LINE_FOLDS)
    + "SELECT member, fold, pipeline, round(predicted / actual, 8) AS predicted_to_actual, round((predicted - actual) / actual, 8) AS relative_error, round(abs(predicted - actual) / actual * 100, 6) AS ape FROM folds",
)
def walk_forward_folds(spark, sf):
    out = bt.walk_forward(bd.filled_panel(spark, sf), "member", "ts", "total", _EVALUATORS, min_train=24)
    return out.select("member", "fold", "pipeline", rd(F.col("predicted") / F.col("actual"), 8).alias("predicted_to_actual"), rd(F.col("error") / F.col("actual"), 8).alias("relative_error"), rd("ape", 6).alias("ape"))


@query(
    "E-20 E-26 E-28 M-25",
    ctes(
        b.PANEL,
        _LINE_FOLDS,
        "d AS (SELECT *, abs(actual - lag(actual) OVER (PARTITION BY member, pipeline ORDER BY fold)) AS dd FROM folds WHERE predicted IS NOT NULL)",
    )
    + "SELECT pipeline, count(*) AS n_folds, CAST(min(fold) AS VARCHAR) || '-' || CAST(max(fold) AS VARCHAR) AS fold_years, round(sqrt(avg((actual - predicted) ** 2)), 3) AS rmse, round(avg(abs(actual - predicted)), 3) AS mae, "
    "round(avg(abs(actual - predicted)) / avg(dd), 6) AS mase, round(avg(abs(predicted - actual) / actual) * 100, 5) AS mape, round(100 - avg(abs(predicted - actual) / actual) * 100, 5) AS accuracy_percent FROM d GROUP BY 1",
)
def walk_forward_summary(spark, sf):
    folds = bt.walk_forward(bd.filled_panel(spark, sf), "member", "ts", "total", _EVALUATORS, min_train=24)
    out = mt.fold_summary(folds, "pipeline", "member")
    return out.select(
        "pipeline", "n_folds", "fold_years", rd("rmse", 3).alias("rmse"), rd("mae", 3).alias("mae"), rd("mase", 6).alias("mase"),
        rd("mape", 5).alias("mape"), rd("accuracy_percent", 5).alias("accuracy_percent"),
    )


_DRIVEN = """
dv AS (SELECT member, ts, total AS y, d.density - avg(d.density) OVER (PARTITION BY member) AS a, d.birth_rate - avg(d.birth_rate) OVER (PARTITION BY member) AS c, row_number() OVER (PARTITION BY member ORDER BY ts) AS i
  FROM panel JOIN drv d USING (ts)),
sm AS (SELECT *, count(*) OVER w AS n, avg(a) OVER w AS ma, avg(c) OVER w AS mc, avg(y) OVER w AS my, sum(a * a) OVER w AS aa, sum(a * c) OVER w AS ac, sum(c * c) OVER w AS cc, sum(a * y) OVER w AS ay, sum(c * y) OVER w AS cy
  FROM dv WINDOW w AS (PARTITION BY member ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ct AS (SELECT *, aa - n * ma * ma AS p, ac - n * ma * mc AS q, cc - n * mc * mc AS r, ay - n * ma * my AS u, cy - n * mc * my AS v FROM sm WHERE i > 24),
drf AS (SELECT member, ts AS fold, 'DRIVERS' AS pipeline, y AS actual, my + (u * r - v * q) / (p * r - q * q) * (a - ma) + (v * p - u * q) / (p * r - q * q) * (c - mc) AS predicted FROM ct
  UNION ALL SELECT member, ts, 'TREND', y, my_ + sl * (i - mi) FROM (SELECT *, avg(i) OVER w AS mi, avg(y) OVER w AS my_, regr_slope(y, i) OVER w AS sl FROM dv WINDOW w AS (PARTITION BY member ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE i > 24)
"""


@query(
    "M-25 K-05 E-28",
    ctes(b.PANEL, b.DRIVERS_SQL, _DRIVEN)
    + "SELECT pipeline, count(*) AS n_folds, round(sqrt(avg((actual - predicted) ** 2)), 2) AS rmse, round(avg(abs(actual - predicted)), 2) AS mae, round(avg(abs(predicted - actual) / actual) * 100, 5) AS mape FROM drf GROUP BY 1",
)
def walk_forward_drivers(spark, sf):
    """Folds of a regression on two drivers, refitted in every fold, beside the trend."""
    panel = bd.filled_panel(spark, sf).join(bd.drivers(spark, sf).select("ts", "density", "birth_rate"), "ts")
    folds = bt.walk_forward(panel, "member", "ts", "total", {"DRIVERS": bt.driver_line(["density", "birth_rate"]), "TREND": bt.line}, min_train=24)
    out = mt.fold_summary(folds, "pipeline", "member")
    return out.select("pipeline", "n_folds", rd("rmse", 2).alias("rmse"), rd("mae", 2).alias("mae"), rd("mape", 5).alias("mape"))


@query("M-25")
def walk_forward_all_pipelines(spark, sf):
    """The default pipelines and a regression on all five drivers, one summary row each."""
    panel = checkpointed(bd.filled_panel(spark, sf).join(bd.drivers(spark, sf), "ts"))
    folds = bt.walk_forward(panel, "member", "ts", "total", {**bt.DEFAULT_EVALUATORS, "DRIVERS": bt.driver_line(bd.DRIVERS)}, min_train=24)
    return mt.fold_summary(folds, "pipeline", "member")


_HOLT_GRID = [{"alpha": a, "beta": 0.1, "phi": p, "gamma": 0.0} for a in (0.2, 0.5, 0.8) for p in (0.9, 1.0)]


@query(
    "M-25 M-11 K-05",
    b.ctes(
        b.PANEL,
        "num AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS i FROM panel)",
        "g(alpha, beta, phi) AS (SELECT * FROM (VALUES " + ", ".join(f"({r['alpha']}::DOUBLE, {r['beta']}::DOUBLE, {r['phi']}::DOUBLE)" for r in _HOLT_GRID) + "))",
        "h AS (SELECT n.member, n.i, alpha, beta, phi, n.total AS l, n2.total - n.total AS b, 0.0::DOUBLE AS sse, n.total AS f, NULL::DOUBLE AS sse_before FROM num n JOIN num n2 ON n2.member = n.member AND n2.i = 2, g WHERE n.i = 1 "
        "UNION ALL SELECT n.member, n.i, alpha, beta, phi, alpha * n.total + (1 - alpha) * (h.l + phi * h.b), beta * (alpha * n.total + (1 - alpha) * (h.l + phi * h.b) - h.l) + (1 - beta) * phi * h.b, "
        "h.sse + (n.total - (h.l + phi * h.b)) ** 2, h.l + phi * h.b, h.sse FROM h JOIN num n ON n.member = h.member AND n.i = h.i + 1)",
        "best AS (SELECT member, i, arg_min(f, {'s': sse_before, 'a': alpha, 'b': beta, 'p': phi}) AS predicted FROM h WHERE i > 24 GROUP BY 1, 2)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT member, ts AS fold, round(total, 3) AS actual, round(predicted, 3) AS predicted FROM best JOIN num USING (member, i)",
)
def walk_forward_smoothing(spark, sf):
    """Trend smoothing with its parameters chosen anew in every fold."""
    run = {"HOLT": bt.holt_refit(_HOLT_GRID)}
    out = bt.walk_forward(bd.filled_panel(spark, sf), "member", "ts", "total", run, min_train=24)
    return out.select("member", "fold", rd("actual", 3).alias("actual"), rd("predicted", 3).alias("predicted"))
