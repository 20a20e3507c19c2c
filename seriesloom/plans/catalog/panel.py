"""Calendars, gap filling, lag features, splits and the master tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import text as tx
from seriesloom.functions import time as tm
from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import fill, ranking, splits
from seriesloom.operators import smoothing as sm
from seriesloom.operators.keys import one_value
from seriesloom.plans import bindings as bd
from seriesloom.plans import masters
from seriesloom.plans.catalog import base as b
from seriesloom.plans.catalog.base import big, ctes, query, rd
from seriesloom.session import checkpointed

# -- grouping --------------------------------------------------------------------------------------


@query(
    "E-03",
    ctes(
        "m AS (SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS ts, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2)"
    )
    + "SELECT event_type, ts, round(mean_value, 6) AS mean_value, n FROM m",
)
def month_bucket_means(spark, sf):
    events = bd.table(spark, sf, "events")
    cells = cal.month_buckets(events, ["event_type"], "ts", {"mean_value": F.avg("value"), "n": F.count(F.lit(1))})
    full = cal.regularise(cells, "event_type")
    return full.select("event_type", "ts", rd("mean_value", 6).alias("mean_value"), "n")


@query("E-03 M-30", ctes(b.CELLS, b.GAPS) + "SELECT member, ts, total FROM gaps")
def regular_month_grid(spark, sf):
    return bd.member_panel(spark, sf)


@query(
    "E-11",
    ctes(b.CELLS) + "SELECT member, min(ts) AS ts, min_by(total, ts) AS total FROM cells GROUP BY 1",
)
def first_row_per_member(spark, sf):
    return ranking.first_per_group(bd.member_cells(spark, sf), "member", F.col("ts"))


@query("E-13", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY 1, 2")
def distinct_sorted_values(spark, sf):
    return ranking.distinct_sorted(bd.table(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@query(
    "E-14",
    "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1",
)
def last_order_per_customer(spark, sf):
    orders = bd.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    packed = F.shiftleft(F.unix_date(F.to_date("o_orderdate")).cast("long"), 44) + F.col("o_orderkey")  # day and key (below 2^44) in one number: the aggregate can hash
    last = ranking.dedupe_keep_last(orders.withColumn("o_orderdate", F.to_date("o_orderdate")), "o_custkey", packed)
    return last.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "E-12",
    "SELECT count(DISTINCT c_nationkey) AS members, round(max(c_acctbal), 2) AS best, round(min(c_acctbal), 2) AS worst, "
    "round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median FROM customer",
)
def column_summary(spark, sf):
    customers = bd.table(spark, sf, "customer")
    median = ranking.exact_median(customers, "c_acctbal").select(rd("median").alias("v")).scalar()
    stats = customers.agg(
        F.count_distinct("c_nationkey").alias("members"), rd(F.max("c_acctbal"), 2).alias("best"),
        rd(F.min("c_acctbal"), 2).alias("worst"), rd(F.avg("c_acctbal")).alias("mean"),
    )
    return stats.withColumn("median", median)


@query(
    "E-29",
    "SELECT 'orders' AS table_name, count(*) AS n_rows, 6 AS n_columns, "
    "'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns, "
    "count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS filled_cells, "
    "min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year, (SELECT string_agg(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority), ';' ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)) AS first_rows FROM orders "
    "UNION ALL SELECT 'customer', count(*), 5, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment', "
    "count(c_custkey) + count(c_name) + count(c_nationkey) + count(c_acctbal) + count(c_mktsegment), NULL, NULL, "
    "(SELECT string_agg(concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment), ';' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 3)) FROM customer",
)
def table_profile(spark, sf):
    from seriesloom.operators.shaping import profile

    orders = profile(bd.table(spark, sf, "orders"), "orders", "o_orderdate", "o_orderkey")
    return orders.unionByName(profile(bd.table(spark, sf, "customer"), "customer", order="c_custkey"))


@query(
    "E-07",
    ctes(b.NATIONAL, b.DRIVERS_SQL, "w AS (SELECT * FROM nat JOIN drv USING (ts))")
    + "SELECT feature, round(corr, 8) AS corr FROM (SELECT corr(birth_rate, total) AS birth_rate, corr(death_rate, total) AS death_rate, corr(density, total) AS density, "
    "corr(rural, total) AS rural, corr(urban, total) AS urban FROM w) UNPIVOT (corr FOR feature IN (birth_rate, death_rate, density, rural, urban)) ORDER BY corr DESC",
)
def driver_correlations(spark, sf):
    wide = bd.national(spark, sf).join(bd.drivers(spark, sf), "ts")
    out = ft.correlations(wide, "total", bd.DRIVERS)
    return out.orderBy(F.desc("corr")).select("feature", rd("corr", 8).alias("corr"))


@query(
    "E-05",
    ctes(b.YEARLY, "m AS (SELECT member, avg(year) AS my FROM yearly WHERE year <= (SELECT max(year) - 2 FROM yearly) GROUP BY 1)")
    + "SELECT member, year, round(year - my, 6) AS year_centered, round((year - my) ** 2, 6) AS year_centered2, lag(total) OVER w AS total_lag1, "
    "lag(total, 2) OVER w AS total_lag2 FROM yearly JOIN m USING (member) WINDOW w AS (PARTITION BY member ORDER BY year)",
)
def centred_year_features(spark, sf):
    yearly = bd.yearly_members(spark, sf)
    w = ft.series_window("member", "year")
    mean = F.avg(F.when(F.col("year") <= bd.last_complete_year(spark, sf) - 2, F.col("year"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = ft.yearly_trend_features(yearly, "member", "year", "total", mean)
    return out.select("member", "year", rd("year_centered", 6).alias("year_centered"), rd("year_centered2", 6).alias("year_centered2"), "total_lag1", "total_lag2")


@query(
    "E-06",
    ctes(
        b.MEMBER_WIDE,
        "s AS (SELECT member, avg(total) AS mt, stddev_pop(total) AS st, avg(national) AS mn, stddev_pop(national) AS sn FROM wide WHERE ts < make_date(" + b.LAST_YEAR + ", 1, 1) GROUP BY 1)",
    )
    + "SELECT member, ts, round((total - mt) / st, 6) AS total, round((national - mn) / sn, 6) AS national, 0.0::DOUBLE AS flat FROM wide JOIN s USING (member)",
)
def scaled_features(spark, sf):
    """Scaled by the months before the last complete year; a constant column stays 0 because its deviation counts as 1."""
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    wide = panel.join(nat, "ts", "left").withColumn("flat", F.lit(3.0))
    cols = ["total", "national", "flat"]
    stats = ft.scaler(wide, "member", cols, F.col("ts") < F.make_date(bd.last_complete_year(spark, sf), F.lit(1), F.lit(1)))
    return ft.standardise(wide, stats, "member", cols).select("member", "ts", *[rd(c, 6).alias(c) for c in cols])


# -- windows ---------------------------------------------------------------------------------------


@query(
    "F-01 F-02 F-04 K-06 I-14",
    ctes(b.PANEL, b.FEATURES.replace("{source}", "panel"))
    + "SELECT member, ts, round(lag_1, 4) AS lag_1, round(lag_12, 4) AS lag_12, round(rolling_mean_3, 4) AS rolling_mean_3, round(fractional_year, 8) AS fractional_year, "
    "round(month_sin, 8) + 0 AS month_sin, round(month_cos, 8) + 0 AS month_cos FROM featured",
)
def time_features(spark, sf):
    out = ft.add_time_features(bd.filled_panel(spark, sf), "total", "member")
    return out.select(
        "member", "ts", *[rd(c).alias(c) for c in ("lag_1", "lag_12", "rolling_mean_3")],
        *[rd(c, 8).alias(c) for c in ("fractional_year", "month_sin", "month_cos")],
    )


@query(
    "F-03",
    ctes(b.DRIVERS_SQL)
    + "SELECT ts, " + ", ".join(f"round(lag({d}) OVER (ORDER BY ts), 6) AS {d}_lag1" for d in bd.DRIVERS) + " FROM drv",
)
def driver_lags(spark, sf):
    drv = bd.drivers(spark, sf).withColumn("member", F.lit("TOTAL"))
    out = ft.driver_lags(drv, "member", "ts", bd.DRIVERS)
    return out.select("ts", *[rd(f"{d}_lag1", 6).alias(f"{d}_lag1") for d in bd.DRIVERS])


@query(
    "F-05",
    ctes(b.DRIVERS_SQL)
    + "SELECT ts, round(avg(birth_rate) OVER (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 0.5, 8) AS proxy3, "
    "round(avg(birth_rate) OVER (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) * 0.5, 8) AS proxy12, TRUE AS is_proxy FROM drv",
)
def proxy_drivers(spark, sf):
    drv = bd.drivers(spark, sf).withColumn("member", F.lit("TOTAL"))
    return drv.select(
        "ts", rd(ft.proxy_from_mean("birth_rate", "member", "ts", 3), 8).alias("proxy3"),
        rd(ft.proxy_from_mean("birth_rate", "member", "ts", 12), 8).alias("proxy12"), F.lit(True).alias("is_proxy"),
    )


@query("F-06", ctes(b.PANEL) + "SELECT member, ts, round(total, 4) AS total FROM panel")
def interpolated_panel(spark, sf):
    return bd.filled_panel(spark, sf).select("member", "ts", rd("total").alias("total"))


# customer segment x nation: sparse monthly cells with leading and trailing gaps
_SPARSE = (
    "cells AS (SELECT n_name || '/' || c_mktsegment AS member, CAST(date_trunc('month', o_orderdate) AS DATE) AS ts, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
)


def _sparse_cells(spark, sf):
    per_customer = (
        bd.table(spark, sf, "orders")
        .groupBy("o_custkey", tm.month_start(F.col("o_orderdate")).alias("ts"))
        .agg(F.sum(bd.cents("o_totalprice")).alias("amount"))
    )
    segments = bd.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    members = bd.customer_members(spark, sf).join(segments, "c_custkey").select(
        F.col("c_custkey").alias("o_custkey"), F.concat_ws("/", "member", "c_mktsegment").alias("member")
    )
    summed = per_customer.join(members, "o_custkey").groupBy("member", "ts").agg(F.sum("amount").alias("amount"))
    return summed.select("member", "ts", (F.col("amount") / F.lit(100.0)).alias("total"))


@query(
    "F-06",
    ctes(_SPARSE, b.GAPS, b.interpolated("f", "gaps", edge="forward")) + "SELECT member, ts, round(total, 4) AS total FROM f",
)
def interpolated_forward(spark, sf):
    grid = cal.regularise(_sparse_cells(spark, sf), "member")
    return fill.interpolate(grid, "member", "ts", ["total"], edge="forward").select("member", "ts", rd("total").alias("total"))


@query(
    "F-07",
    ctes(_SPARSE, b.GAPS)
    + "SELECT member, ts, coalesce(last_value(total IGNORE NULLS) OVER up, first_value(total IGNORE NULLS) OVER dn) AS total FROM gaps "
    "WINDOW up AS (PARTITION BY member ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY member ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)
def filled_both_ways(spark, sf):
    grid = cal.regularise(_sparse_cells(spark, sf), "member")
    return fill.fill_both_ways(grid, "member", "ts", ["total"])


@query(
    "F-08",
    ctes(
        _SPARSE,
        b.GAPS,
        "pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY member ORDER BY ts) AS DOUBLE) AS x FROM gaps)",
        "anchors AS (SELECT member, x, total AS v, lag(x) OVER w AS px, lag(total) OVER w AS pv, lead(x) OVER w AS nx, lead(total) OVER w AS nv FROM pos WHERE total IS NOT NULL WINDOW w AS (PARTITION BY member ORDER BY x))",
        "l AS (SELECT p.member, p.ts, p.x, p.total, a.x AS ax, a.v AS av, a.px, a.pv FROM pos p ASOF LEFT JOIN anchors a ON p.member = a.member AND p.x >= a.x)",
        "r AS (SELECT l.*, b.x AS bx, b.v AS bv, b.nx, b.nv FROM l ASOF LEFT JOIN anchors b ON l.member = b.member AND l.x <= b.x)",
        "c AS (SELECT *, coalesce(px, nx) AS cx, CASE WHEN px IS NOT NULL THEN pv ELSE nv END AS cv FROM r)",
    )
    + "SELECT member, ts, round(CASE WHEN total IS NOT NULL THEN total WHEN ax IS NULL OR bx IS NULL THEN NULL "
    "WHEN cx IS NULL THEN av + (bv - av) * (x - ax) / (bx - ax) ELSE "
    "av * (x - bx) * (x - cx) / ((ax - bx) * (ax - cx)) + bv * (x - ax) * (x - cx) / ((bx - ax) * (bx - cx)) + cv * (x - ax) * (x - bx) / ((cx - ax) * (cx - bx)) END, 3) AS total FROM c",
)
def quadratic_fill(spark, sf):
    grid = cal.regularise(_sparse_cells(spark, sf), "member")
    return fill.interpolate_quadratic(grid, "member", "ts", "total").select("member", "ts", rd("total", 3).alias("total"))


_FOUR = """
ly AS (SELECT max(year) AS y FROM yearly),
a AS (SELECT member, CAST((year - (SELECT y FROM ly) + 3) * 12 AS DOUBLE) AS x, total AS v FROM yearly WHERE year > (SELECT y FROM ly) - 4),
f AS (SELECT member, max(CASE WHEN x = 0 THEN v END) AS y1, max(CASE WHEN x = 12 THEN v END) AS y2, max(CASE WHEN x = 24 THEN v END) AS y3, max(CASE WHEN x = 36 THEN v END) AS y4 FROM a GROUP BY 1),
c AS (SELECT *, (y4 - 3 * y3 + 3 * y2 - y1) / (18.0::DOUBLE * 18 - 3 * 6.0::DOUBLE * 6) AS k FROM f),
g AS (SELECT *, y3 - k * 36 AS z3 FROM c),
pts AS (SELECT member, CAST(m AS BIGINT) AS month, y1 + (y2 - y1) / 12 * m + (z3 - 2 * y2 + y1) / 288 * m * (m - 12) + k * greatest(m - 18, 0) ** 2 AS total FROM g, range(0, 37) AS t(m))
"""


@query("F-08", ctes(b.YEARLY, _FOUR) + "SELECT member, month, round(total / 365.25::DOUBLE, 4) AS per_day FROM pts")
def spline_of_four_years(spark, sf):
    """The last four complete years brought to months by the order-2 spline through them."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    last = one_value(yearly, F.max("year"))
    anchors = yearly.where(F.col("year") > last - 4).select("member", ((F.col("year") - last + 3) * 12).cast("int").alias("month"), "total")
    grid = anchors.select("member").distinct().withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(36)))).join(anchors, ["member", "month"], "left")
    return fill.interpolate_spline(grid, "member", "month", "total").select("member", big("month").alias("month"), rd(F.col("total") / 365.25).alias("per_day"))


@query("F-08")
def spline_fill(spark, sf):
    """Gaps of every member and segment filled by the order-2 spline through all its months."""
    grid = cal.regularise(_sparse_cells(spark, sf), "member")
    return fill.interpolate_spline(grid, "member", "ts", "total")


_UPSAMPLED = """
stepped AS (SELECT member, year, total, coalesce(lead(total) OVER w - total, total - lag(total) OVER w) AS d, count(*) OVER (PARTITION BY member) AS n
  FROM yearly WINDOW w AS (PARTITION BY member ORDER BY year)),
monthly AS (SELECT member, year, CAST(m AS INT) AS month, CAST(make_date(year, CAST(m AS INT), 1) AS DATE) AS ts, total + (m - 1) / 12.0::DOUBLE * d AS total FROM stepped, range(1, 13) AS t(m) WHERE n >= 2)
"""


@query("F-09 F-10", ctes(b.YEARLY, _UPSAMPLED) + "SELECT member, year, month, ts, round(total, 4) AS total FROM monthly")
def months_from_years(spark, sf):
    out = cal.yearly_to_monthly(bd.yearly_members(spark, sf), "member", "year", ["total"])
    return out.select("member", "year", "month", "ts", rd("total").alias("total"))


@query(
    "F-11 E-04",
    ctes(b.PANEL, "r AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS rn, count(*) OVER (PARTITION BY member) AS n FROM panel)")
    + "SELECT member, CASE WHEN rn <= greatest(1, least(floor(n * 0.85::DOUBLE), n - 1)) THEN 'TRAIN' ELSE 'TEST' END AS split, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY 1, 2",
)
def two_way_split_ranges(spark, sf):
    rows = splits.two_way(bd.filled_panel(spark, sf), "member", "ts", 0.85)
    return rows.groupBy("member", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("F-12", ctes(b.SPLIT3) + "SELECT member, ts, rn, split FROM parts")
def three_way_split(spark, sf):
    rows = splits.three_way(bd.filled_panel(spark, sf), "member", "ts")
    return rows.select("member", "ts", big("rn").alias("rn"), "split")


@query(
    "F-13 C-10",
    ctes(
        b.YEARLY,
        "s AS (SELECT *, CASE WHEN year <= (SELECT max(year) - 2 FROM yearly) THEN 'TRAIN' WHEN year <= (SELECT max(year) - 1 FROM yearly) THEN 'VAL' ELSE 'TEST' END AS split FROM yearly)",
        "ok AS (SELECT member FROM s GROUP BY 1 HAVING count(CASE WHEN split = 'TRAIN' THEN 1 END) >= 3 AND count(CASE WHEN split = 'VAL' THEN 1 END) >= 1 AND count(CASE WHEN split = 'TEST' THEN 1 END) >= 1)",
    )
    + "SELECT member, year, split FROM s WHERE member IN (SELECT member FROM ok)",
)
def fixed_year_split(spark, sf):
    yearly = checkpointed(bd.yearly_members(spark, sf))
    last = one_value(yearly, F.max("year"))
    rows = splits.by_year(yearly, F.col("year"), last - 2, last - 1)
    return splits.members_with_sizes(rows, "member", {"TRAIN": 3, "VAL": 1, "TEST": 1}).select("member", "year", "split")


@query(
    "F-17",
    ctes(
        b.SPLIT3,
        "e AS (SELECT member, max(CASE WHEN split = 'TRAIN' THEN rn END) AS te FROM parts GROUP BY 1)",
        "src AS (SELECT p.*, CASE WHEN rn <= te THEN rn - 12 ELSE te - 11 + (rn - te - 1) % 12 END AS s FROM parts p JOIN e USING (member))",
    )
    + "SELECT s.member, s.ts, s.split, round(h.total, 4) AS predicted FROM src s LEFT JOIN parts h ON h.member = s.member AND h.rn = s.s",
)
def seasonal_naive_forecast(spark, sf):
    rows = splits.three_way(bd.filled_panel(spark, sf), "member", "ts")
    train_end = splits.three_way_bounds(0.7, 0.1)[0]
    out = sm.seasonal_naive(rows, "member", "total", train_end, 12)
    return out.select("member", "ts", "split", rd("predicted").alias("predicted"))


# -- masters ---------------------------------------------------------------------------------------

_YMASTER = (
    "ym0 AS (SELECT coalesce(a.year, d.year) AS year, 'TOTAL' AS member, a.total, d.birth_rate, d.death_rate, d.density, d.rural, d.urban FROM ynat a FULL JOIN ydrv d USING (year))"
)


def _ymaster_sql():
    parts, source = [b.YEARLY_NATIONAL, b.YEARLY_DRIVERS, _YMASTER], "ym0"
    for i, c in enumerate(["total", *bd.DRIVERS], start=1):
        parts.append(b.interpolated(f"ym{i}", source, c, "member", "year"))
        source = f"ym{i}"
    return parts, source


_YM_PARTS, _YM = _ymaster_sql()
_COLS = ["total", *bd.DRIVERS]
_MONTHLY_ALL = (
    "stp AS (SELECT member, year, " + ", ".join(_COLS) + ", " + ", ".join(f"coalesce(lead({c}) OVER w - {c}, {c} - lag({c}) OVER w) AS d_{c}" for c in _COLS)
    + f" FROM {_YM} WINDOW w AS (PARTITION BY member ORDER BY year)), "
    "nm AS (SELECT member, CAST(make_date(year, CAST(m AS INT), 1) AS DATE) AS ts, " + ", ".join(f"{c} + (m - 1) / 12.0::DOUBLE * d_{c} AS {c}" for c in _COLS)
    + " FROM stp, range(1, 13) AS t(m))"
)
_LAGGED = "nml AS (SELECT *, " + ", ".join(f"lag({d}) OVER (PARTITION BY member ORDER BY ts) AS {d}_lag1" for d in bd.DRIVERS) + " FROM featured)"


def _yearly_master(spark, sf, total=None):
    total = bd.yearly_national(spark, sf) if total is None else total
    drv = checkpointed(bd.yearly_drivers(spark, sf))
    parts = [total.select("year", "total"), *[drv.select("year", d) for d in bd.DRIVERS]]
    return masters.yearly_master(parts, _COLS)


def _national_monthly(spark, sf, total=None):
    return masters.monthly_master(_yearly_master(spark, sf, total), "total", bd.DRIVERS)


@query("M-30 J-02 F-06", ctes(*_YM_PARTS) + "SELECT year, " + ", ".join(f"round({c}, 6) AS {c}" for c in _COLS) + f" FROM {_YM}")
def yearly_master(spark, sf):
    return _yearly_master(spark, sf).select("year", *[rd(c, 6).alias(c) for c in _COLS])


@query(
    "M-30 F-03 C-05",
    ctes(*_YM_PARTS, _MONTHLY_ALL, b.FEATURES.replace("{source}", "nm"), _LAGGED)
    + "SELECT ts, round(total, 3) AS total, round(lag_1, 3) AS lag_1, round(lag_12, 3) AS lag_12, round(rolling_mean_3, 3) AS rolling_mean_3, "
    + ", ".join(f"round({d}_lag1, 3) AS {d}_lag1" for d in bd.DRIVERS)
    + " FROM nml WHERE lag_12 IS NOT NULL AND rolling_mean_3 IS NOT NULL AND birth_rate_lag1 IS NOT NULL",
)
def national_monthly_master(spark, sf):
    cols = ["total", "lag_1", "lag_12", "rolling_mean_3", *[f"{d}_lag1" for d in bd.DRIVERS]]
    return _national_monthly(spark, sf).select("ts", *[rd(c, 3).alias(c) for c in cols])


@query(
    "M-30 J-03",
    ctes(
        *_YM_PARTS,
        _MONTHLY_ALL,
        b.FEATURES.replace("{source}", "nm"),
        _LAGGED,
        "nmast AS (SELECT ts, total AS national, birth_rate_lag1 FROM nml WHERE lag_12 IS NOT NULL AND rolling_mean_3 IS NOT NULL AND birth_rate_lag1 IS NOT NULL)",
        b.YEARLY,
        _UPSAMPLED,
        "mm AS (SELECT m.member, m.ts, m.total, n.national, n.birth_rate_lag1, lag(m.total) OVER w AS lag_1, lag(m.total, 12) OVER w AS lag_12, lag(national) OVER w AS national_lag_1, lag(national, 12) OVER w AS national_lag_12 "
        "FROM monthly m LEFT JOIN nmast n USING (ts) WINDOW w AS (PARTITION BY member ORDER BY ts))",
    )
    + "SELECT member, ts, round(total, 3) AS total, round(national, 3) AS national, round(lag_1, 3) AS lag_1, round(lag_12, 3) AS lag_12, round(national_lag_1, 3) AS national_lag_1, "
    "round(national_lag_12, 3) AS national_lag_12 FROM mm WHERE lag_12 IS NOT NULL AND national_lag_12 IS NOT NULL AND national IS NOT NULL AND national_lag_1 IS NOT NULL",
)
def member_monthly_master(spark, sf):
    yearly, total = bd.members_and_total(spark, sf)
    nat = _national_monthly(spark, sf, total).withColumnRenamed("total", "national")
    out = masters.member_monthly_master(yearly, nat, "total", "national")
    cols = ["total", "national", "lag_1", "lag_12", "national_lag_1", "national_lag_12"]
    return out.select("member", "ts", *[rd(c, 3).alias(c) for c in cols])


@query(
    "M-30",
    ctes(
        "base AS (SELECT n_name AS member, CAST(year(o_orderdate) AS INT) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS orders, "
        "CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS urgent "
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) <= " + b.LAST_YEAR + " GROUP BY 1, 2)",
        "st AS (SELECT *, " + ", ".join(f"coalesce(lead({c}) OVER w - {c}, {c} - lag({c}) OVER w) AS d_{c}" for c in ("total", "orders", "urgent")) + " FROM base WINDOW w AS (PARTITION BY member ORDER BY year))",
        "mo AS (SELECT member, CAST(make_date(year, CAST(m AS INT), 1) AS DATE) AS ts, " + ", ".join(f"{c} + (m - 1) / 12.0::DOUBLE * d_{c} AS {c}" for c in ("total", "orders", "urgent")) + " FROM st, range(1, 13) AS t(m))",
        "nt AS (SELECT CAST(make_date(year, CAST(m AS INT), 1) AS DATE) AS ts, total + (m - 1) / 12.0::DOUBLE * d AS national FROM (SELECT year, total, coalesce(lead(total) OVER w - total, total - lag(total) OVER w) AS d "
        "FROM (SELECT year, CAST(sum(CAST(total AS DECIMAL(18,2))) AS DOUBLE) AS total FROM base GROUP BY 1) WINDOW w AS (ORDER BY year)), range(1, 13) AS t(m))",
        "j AS (SELECT *, lag(total, 12) OVER w AS lag_12, lag(national, 12) OVER w AS national_lag_12 FROM mo JOIN nt USING (ts) WINDOW w AS (PARTITION BY member ORDER BY ts))",
    )
    + "SELECT member, ts, round(total / 7, 3) AS total, round(orders / 7, 5) AS orders, round(urgent / 7, 3) AS urgent, round(lag_12 / 7, 3) AS lag_12, round(national_lag_12 / 7, 3) AS national_lag_12 FROM j WHERE lag_12 IS NOT NULL",
)
def member_measures_master(spark, sf):
    """Three measures per member brought to months on the national months: values, number of orders and urgent value, as sevenths."""
    orders = bd.table(spark, sf, "orders").where(F.year("o_orderdate") <= bd.last_complete_year(spark, sf)).withColumn("year", F.year("o_orderdate"))
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", bd.cents("o_totalprice")).otherwise(0)
    per_customer = orders.groupBy("o_custkey", "year").agg(F.sum(bd.cents("o_totalprice")).alias("t"), F.count("*").alias("n"), F.sum(urgent).alias("u"))
    named = per_customer.join(bd.customer_members(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    yearly = checkpointed(named.groupBy("member", "year").agg((F.sum("t") / F.lit(100.0)).alias("total"), F.sum("n").cast("double").alias("orders"), (F.sum("u") / F.lit(100.0)).alias("urgent")))
    national = cal.yearly_to_monthly(bd.total_of(yearly, "year"), "member", "year", ["total"]).withColumnRenamed("total", "national")
    out = masters.member_monthly_master(yearly, national, "total", "national", measures=["orders", "urgent"])
    sevenths = [rd(F.col(c) / 7, 5 if c == "orders" else 3).alias(c) for c in ("total", "orders", "urgent", "lag_12", "national_lag_12")]
    return out.select("member", "ts", *sevenths)


@query(
    "M-30 I-05",
    ctes(
        b.YEARLY,
        "cells AS (SELECT member, CAST(make_date(year, 12, 1) AS DATE) AS ts, total FROM yearly)",
        "grid AS (SELECT member, CAST(unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS DATE) AS ts FROM cells GROUP BY 1)",
        "gaps AS (SELECT member, ts, total FROM grid LEFT JOIN cells USING (member, ts))",
        b.interpolated("panel", "gaps", edge="forward"),
    )
    + "SELECT member, ts, round(total, 4) AS total FROM panel",
)
def months_between_year_ends(spark, sf):
    return masters.anchored_member_months(bd.yearly_members(spark, sf)).select("member", "ts", rd("total").alias("total"))


_GAPPY = "gy AS (SELECT member, year, total FROM yearly WHERE year NOT IN ((SELECT min(year) FROM yearly) + 2, (SELECT min(year) FROM yearly) + 3))"


@query(
    "M-32 F-06",
    ctes(
        b.YEARLY,
        _GAPPY,
        "cells AS (SELECT member, CAST(make_date(year, 1, 1) AS DATE) AS ts, total FROM gy)",
        "grid AS (SELECT member, CAST(unnest(generate_series(make_date(min(year), 1, 1), make_date(max(year), 12, 1), INTERVAL 1 MONTH)) AS DATE) AS ts FROM gy GROUP BY 1)",
        "gaps AS (SELECT member, ts, total FROM grid LEFT JOIN cells USING (member, ts))",
        b.interpolated("panel", "gaps"),
    )
    + "SELECT member, ts, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, round(total, 4) AS total FROM panel",
)
def gappy_years_to_months(spark, sf):
    yearly = checkpointed(bd.yearly_members(spark, sf))
    first = one_value(yearly, F.min("year"))  # a table with a hole of two years after its first two
    gappy = yearly.where((F.col("year") != first + 2) & (F.col("year") != first + 3))
    out = masters.gappy_years_to_months(gappy, "member", "year", ["total"])
    return out.select("member", "ts", big("year").alias("year"), big("month").alias("month"), rd("total").alias("total"))


@query(
    "M-29 F-05 F-07 F-11 E-05",
    ctes(
        b.PANEL,
        b.DRIVERS_SQL,
        "w0 AS (SELECT p.member, p.ts, p.total, d.birth_rate, d.density FROM panel p LEFT JOIN drv d USING (ts))",
        "w1 AS (SELECT *, avg(birth_rate) OVER (PARTITION BY member ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) * 0.5 AS death_rate FROM w0)",
        "w2 AS (SELECT *, lag(total) OVER w AS total_lag1, lag(total, 2) OVER w AS total_lag2, lag(birth_rate) OVER w AS birth_rate_lag1, lag(density) OVER w AS density_lag1, lag(death_rate) OVER w AS death_rate_lag1 FROM w1 WINDOW w AS (PARTITION BY member ORDER BY ts))",
        "w3 AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS rn, count(*) OVER (PARTITION BY member) AS n FROM w2 WHERE total_lag2 IS NOT NULL)",
        "w4 AS (SELECT *, CASE WHEN rn <= greatest(3, least(floor(n * 0.8::DOUBLE), n - 2)) THEN 'TRAIN' ELSE 'TEST' END AS split, year(ts) * 12 + month(ts) AS step FROM w3)",
    )
    + "SELECT member, ts, split, round(total_lag1, 4) AS total_lag1, round(total_lag2, 4) AS total_lag2, round(birth_rate_lag1, 8) AS birth_rate_lag1, round(density_lag1, 6) AS density_lag1, "
    "round(death_rate_lag1, 8) AS death_rate_lag1, round(step - avg(CASE WHEN split = 'TRAIN' THEN step END) OVER (PARTITION BY member), 6) AS year_centered FROM w4",
)
def evaluation_frame(spark, sf):
    """Member months as steps; the death rate is absent and gets its proxy."""
    drv = bd.drivers(spark, sf).select("ts", "birth_rate", "density")
    wide = bd.filled_panel(spark, sf).join(drv, "ts", "left").withColumn("step", tm.month_index(F.col("ts")))
    out = masters.evaluation_frame(wide, "member", "step", "total", ["birth_rate", "density"], 0.8, ("death_rate", "birth_rate"))
    return out.select(
        "member", "ts", "split", rd("total_lag1").alias("total_lag1"), rd("total_lag2").alias("total_lag2"),
        rd("birth_rate_lag1", 8).alias("birth_rate_lag1"), rd("density_lag1", 6).alias("density_lag1"),
        rd("death_rate_lag1", 8).alias("death_rate_lag1"), rd("year_centered", 6).alias("year_centered"),
    )


@query(
    "M-31 B-04 B-05 I-03 C-06 E-14",
    ctes(b.YEARLY)
    + "SELECT member, year AS \"Year\", total AS \"National_Population\", round(total / 62710.0, 6) AS \"Population_Density\", round(total * (25 / 100.0::DOUBLE), 4) AS \"Urban_Population\", "
    "CAST(make_date(year, 12, 31) AS DATE) AS \"Date\" FROM yearly",
)
def statistics_table(spark, sf):
    """Yearly totals dressed as a scraped table: decorated headings, text cells, duplicate and blank years."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    text = tx.fixed(F.col("total"), 2)
    dressed = yearly.select(
        "member", F.lit(1).alias("version"), F.col("year").cast("string").alias(" Year "),
        F.concat(text, F.lit(" ")).alias("Population"), F.lit("25 %").alias("Urban Pop"),
    )
    older = dressed.withColumn("version", F.lit(0)).withColumn("Population", F.lit("1,000"))
    blank = dressed.withColumn(" Year ", F.lit("N.A."))
    raw = dressed.unionByName(older).unionByName(blank)
    out = masters.standardise_statistics(raw, ["member"], "version")
    return out.select(
        "member", "Year", "National_Population", rd("Population_Density", 6).alias("Population_Density"),
        rd("Urban_Population").alias("Urban_Population"), "Date",
    )
