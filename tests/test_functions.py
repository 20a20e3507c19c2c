import math

import numpy as np
from pyspark.sql import functions as F

from seriesloom.functions import linalg as la
from seriesloom.functions import numeric as nm
from seriesloom.functions import text as tx
from seriesloom.functions import time as tm


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_clean_name_python_and_column_agree(spark):
    names = ["Yearly % Change", " Density (P/Km²) ", "Country's Share of World Pop", "Migrants (net)", "a--b..c", "Urban Pop %"]
    want = ["Yearly_Percent_Change", "Density_P_Km²", "Countrys_Share_of_World_Pop", "Migrants_net", "a_b_c", "Urban_Pop_Percent"]
    assert [tx.clean_name(n) for n in names] == want
    df = spark.createDataFrame([(n,) for n in names], "n string").select(tx.clean_name_col(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == want


def test_to_number(spark):
    cases = {"21,763,170": 21763170.0, "0.49 %": 0.49, "−1.2": -1.2, "N.A.": None, "": None, "nan": None, "None": None, "7": 7.0, "NaN": None, "7d": None, "1e3": 1000.0}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tx.to_number(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases


def test_formats(spark):
    assert one(spark, tx.thousands(F.lit(1234567.6))) == "1,234,568"
    assert one(spark, tx.fixed(F.lit(1.23456), 4)) == "1.2346"
    assert one(spark, tx.percent(F.lit(0.123456), 4)) == "12.3456%"
    assert one(spark, tx.table_row(F.lit("a"), F.lit("b"))) == "| a | b |"


def test_calendar(spark):
    d = F.lit("2001-03-15").cast("date")
    assert str(one(spark, tm.year_end(F.lit(2001)))) == "2001-12-31"
    assert str(one(spark, tm.first_month_after_year(F.lit(2001)))) == "2002-01-31"
    assert one(spark, tm.month_steps(F.lit("2002-01-01").cast("date"), d)) == 10
    assert one(spark, tm.fractional_year(d)) == 2001 + 2 / 12
    assert one(spark, tm.season(d)) == "Maha" and one(spark, tm.season(F.lit("2001-09-30").cast("date"))) == "Yala"
    assert one(spark, tm.parse_date(F.lit("not a date"))) is None
    assert one(spark, tm.month_text(F.lit(2001), F.lit(3))) == "2001-03-01"
    assert math.isclose(one(spark, tm.month_sin(d)), 1.0) and abs(one(spark, tm.month_cos(d))) < 1e-12


def test_numeric(spark):
    inf = float("inf")
    assert [one(spark, nm.clean_share(F.lit(v))) for v in (0.9, 0.001, inf, -inf, float("nan"))] == [0.9, 0.001, 0.3, 0.01, 0.05]
    held = [one(spark, nm.clean_share(F.lit(v), nm.SHARE_RANGE)) for v in (0.9, 0.001, inf, -inf, float("nan"))]
    assert held == [0.5, 0.01, 0.5, 0.01, 0.05]
    assert one(spark, nm.fit_status(F.lit(0.0), F.lit(40.0))).startswith("Over") and one(spark, nm.fit_status(F.lit(0.0), F.lit(0.0))) == "Good Fit"
    assert one(spark, nm.half_even(F.lit(2.5), 0)) == 2.0
    assert one(spark, nm.truncate(F.lit(-2.7))) == -2
    assert one(spark, nm.selection_score(F.lit(1.0), F.lit(2.0))) == 3.0
    assert one(spark, nm.selection_score(F.lit(0.1), F.lit(0.4))) == 0.4
    assert one(spark, nm.aicc(F.lit(10.0), F.lit(5), F.lit(4))) is None
    assert one(spark, nm.fit_status(F.lit(6.0), F.lit(1.0))).startswith("Under")
    assert one(spark, nm.fit_status(F.lit(1.0), F.lit(6.0))).startswith("Over")
    assert [one(spark, nm.overfit_level(F.lit(1.0), F.lit(v))) for v in (4.9, 5.0, 10.0)] == ["OK", "Check", "Overfitting"]


def test_solver_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)) * [1, 1000, 0.01], rng.normal(size=40)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    sums = df.agg(*la.moment_sums([F.col("a"), F.col("b"), F.col("c")], F.col("y")))
    full = sums.select(la.solve(3).alias("v")).first().v
    assert np.allclose(full, np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-7)
    part = sums.select(la.solve(3, cols=F.array(F.lit(0), F.lit(2))).alias("v")).first().v
    assert part[1] == 0 and np.allclose([part[0], part[2]], np.linalg.lstsq(x[:, [0, 2]], y, rcond=None)[0], rtol=1e-7)
    ridge = sums.select(la.solve(3, ridge=5.0, unpenalised=1).alias("v")).first().v
    assert np.allclose(ridge, np.linalg.solve(x.T @ x + np.diag([0, 5, 5]), x.T @ y), rtol=1e-6)
    none = sums.select(la.solve(3, cols=F.expr("cast(array() as array<int>)")).alias("v")).first().v
    assert none == [0.0, 0.0, 0.0]
