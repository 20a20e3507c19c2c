"""Query registry and the SQL building blocks that describe the panels of ``plans.bindings``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a query under its function name; ``covers`` lists the operators it exercises."""

    def register(run: Run) -> Run:
        name = run.__name__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, tuple(covers.split()), run, sql)
        return run

    return register


def rd(c: str | Column, digits: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
_AMOUNT = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)"
_FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"

CELLS = f"cells AS (SELECT n_name AS member, {_MONTH} AS ts, {_AMOUNT} AS total {_FROM} GROUP BY 1, 2)"

GAPS = """
grid AS (SELECT member, CAST(unnest(generate_series((SELECT min(ts) FROM cells), (SELECT max(ts) FROM cells), INTERVAL 1 MONTH)) AS DATE) AS ts
  FROM (SELECT DISTINCT member FROM cells)),
gaps AS (SELECT member, ts, total FROM grid LEFT JOIN cells USING (member, ts))
"""


def interpolated(name: str, source: str, value: str = "total", key: str = "member", ts: str = "ts", edge: str = "both") -> str:
    """CTEs filling ``value`` of ``source`` along straight lines by row position."""
    lead = "nv" if edge == "both" else "NULL"
    return f"""
{name}_pos AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts}) AS rn_ FROM {source}),
{name}_nb AS (SELECT *,
    last_value(CASE WHEN {value} IS NOT NULL THEN rn_ END IGNORE NULLS) OVER up AS pi, last_value({value} IGNORE NULLS) OVER up AS pv,
    first_value(CASE WHEN {value} IS NOT NULL THEN rn_ END IGNORE NULLS) OVER dn AS ni, first_value({value} IGNORE NULLS) OVER dn AS nv
  FROM {name}_pos
  WINDOW up AS (PARTITION BY {key} ORDER BY {ts} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         dn AS (PARTITION BY {key} ORDER BY {ts} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT * EXCLUDE (rn_, pi, pv, ni, nv) REPLACE (CASE WHEN {value} IS NOT NULL THEN {value} WHEN pv IS NULL THEN {lead}
    WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (rn_ - pi) / (ni - pi) END AS {value}) FROM {name}_nb)
"""


PANEL = CELLS + "," + GAPS + "," + interpolated("panel", "gaps")

NATIONAL = f"nat AS (SELECT 'TOTAL' AS member, {_MONTH} AS ts, {_AMOUNT} AS total FROM orders GROUP BY 2)"


def driver_sql(unit: str = "month", name: str = "drv") -> str:
    return f"""
{name} AS (SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS ts,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS birth_rate,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS death_rate,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS density,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS rural,
  CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS urban
  FROM lineitem GROUP BY 1)
"""


DRIVERS_SQL = driver_sql()

LAST_YEAR = "(SELECT CAST(year(max(o_orderdate) + INTERVAL 1 MONTH) AS INT) - 1 FROM orders)"  # the last complete one

YEARLY = f"""
yearly AS (SELECT n_name AS member, CAST(year(o_orderdate) AS INT) AS year, {_AMOUNT} AS total
  {_FROM} WHERE year(o_orderdate) <= {LAST_YEAR} GROUP BY 1, 2)
"""
YEARLY_NATIONAL = f"""
ynat AS (SELECT CAST(year(o_orderdate) AS INT) AS year, {_AMOUNT} AS total FROM orders WHERE year(o_orderdate) <= {LAST_YEAR} GROUP BY 1)
"""
YEARLY_DRIVERS = driver_sql("year", "ydrv_") + ", ydrv AS (SELECT CAST(year(ts) AS INT) AS year, * EXCLUDE (ts) FROM ydrv_)"

MEMBER_WIDE = PANEL + "," + NATIONAL + "," + DRIVERS_SQL + """,
wide AS (SELECT p.member, p.ts, p.total, n.total AS national, d.* EXCLUDE (ts), p.total / nullif(n.total, 0) AS proportion
  FROM panel p LEFT JOIN nat n USING (ts) LEFT JOIN drv d USING (ts))
"""

FEATURES = """
featured AS (SELECT *, lag(total, 1) OVER w AS lag_1, lag(total, 12) OVER w AS lag_12,
  CASE WHEN count(total) OVER w3 = 3 THEN avg(total) OVER w3 END AS rolling_mean_3,
  year(ts) + (month(ts) - 1) / 12.0::DOUBLE AS fractional_year,
  sin(2 * pi() * month(ts) / 12.0::DOUBLE) AS month_sin, cos(2 * pi() * month(ts) / 12.0::DOUBLE) AS month_cos
  FROM {source}
  WINDOW w AS (PARTITION BY member ORDER BY ts), w3 AS (PARTITION BY member ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
"""

# three-way split of the filled member panel
SPLIT3 = PANEL + """,
numbered AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY ts) AS rn, count(*) OVER (PARTITION BY member) AS n FROM panel),
bounds AS (SELECT *, greatest(24, floor(n * 0.7::DOUBLE)) AS te FROM numbered),
bounds2 AS (SELECT *, least(greatest(te + 12, floor(n * (0.7::DOUBLE + 0.1::DOUBLE))), n - 12) AS ve FROM bounds),
parts AS (SELECT member, ts, total, rn, n, CASE WHEN rn <= te THEN 'TRAIN' WHEN rn <= ve THEN 'VAL' ELSE 'TEST' END AS split
  FROM bounds2 WHERE n >= 48)
"""

# one-step naive and line predictions per split, the usual input of the scoring queries
PREDICTIONS = SPLIT3 + """,
line AS (SELECT member, regr_intercept(total, rn) AS b0, regr_slope(total, rn) AS b1 FROM parts WHERE split = 'TRAIN' GROUP BY 1),
preds AS (
  SELECT member, 'NAIVE' AS model, split, ts, rn, total AS actual, lag(total) OVER (PARTITION BY member ORDER BY ts) AS predicted FROM parts
  UNION ALL
  SELECT member, 'TREND', split, ts, rn, total, b0 + b1 * rn FROM parts JOIN line USING (member))
"""

METRICS = PREDICTIONS + """,
mets AS (SELECT member, model, split, count(*) AS n_rows, sqrt(avg((actual - predicted) ** 2)) AS rmse, avg(abs(actual - predicted)) AS mae,
  avg(abs((actual - predicted) / nullif(actual, 0))) * 100 AS mape,
  1 - sum((actual - predicted) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r2
  FROM preds WHERE predicted IS NOT NULL GROUP BY 1, 2, 3)
"""

CANDIDATES = METRICS + """,
cand AS (SELECT member, model,
  max(CASE WHEN split = 'TRAIN' THEN rmse END) AS train_rmse, max(CASE WHEN split = 'TRAIN' THEN mae END) AS train_mae,
  max(CASE WHEN split = 'TRAIN' THEN mape END) AS train_mape, max(CASE WHEN split = 'VAL' THEN rmse END) AS val_rmse,
  max(CASE WHEN split = 'VAL' THEN mae END) AS val_mae, max(CASE WHEN split = 'VAL' THEN mape END) AS val_mape,
  max(CASE WHEN split = 'TEST' THEN rmse END) AS test_rmse, max(CASE WHEN split = 'TEST' THEN mae END) AS test_mae,
  max(CASE WHEN split = 'TEST' THEN mape END) AS test_mape FROM mets GROUP BY 1, 2),
scored AS (SELECT *, val_mape / greatest(train_mape, 0.5) AS val_train_ratio,
  val_mape * (1 + 0.5 * greatest(0, val_mape / greatest(train_mape, 0.5) - 1)) AS selection_score FROM cand)
"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Naive and train-line predictions of the filled member panel with their split."""
    from seriesloom.operators import splits
    from seriesloom.operators import trend as tr
    from seriesloom.operators.keys import series_window
    from seriesloom.plans import bindings as bd

    rows = splits.three_way(bd.filled_panel(spark, sf), "member", "ts")
    line = tr.linear_trend(rows, "member", "rn", "total", F.col("split") == "TRAIN")
    cols = ["member", "model", "split", "ts", "rn", F.col("total").alias("actual"), "predicted"]
    naive = rows.withColumns(
        {"model": F.lit("NAIVE"), "predicted": F.lag("total").over(series_window("member", "ts"))}
    ).select(*cols)
    trend = tr.predict_line(rows, line, "member", "rn").withColumn("model", F.lit("TREND")).select(*cols)
    return naive.unionByName(trend)


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.operators import metrics as mt

    return mt.bundle(predictions(spark, sf), ["member", "model", "split"])


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.operators import metrics as mt

    return mt.split_bundle(predictions(spark, sf), ["member", "model"]).withColumn("params", F.lit("{}"))
