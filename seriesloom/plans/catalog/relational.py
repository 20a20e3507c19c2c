"""Scans, sinks, projections, filters, plain joins, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import numeric as nm
from seriesloom.functions import text as tx
from seriesloom.functions import time as tm
from seriesloom.operators import backtest as bt
from seriesloom.operators import calendar as cal
from seriesloom.operators import features as ft
from seriesloom.operators import forecasting as fc
from seriesloom.operators import joins, ranking, shaping, splits
from seriesloom.operators import metrics as mt
from seriesloom.operators import trend as tr
from seriesloom.operators.keys import one_value, series_window
from seriesloom.plans import bindings as bd
from seriesloom.plans import masters
from seriesloom.plans.catalog import base as b
from seriesloom.plans.catalog.base import big, ctes, query, rd
from seriesloom.session import checkpointed, scratch_path
from seriesloom.sources import grids, pages, readers, sinks

# -- scans, sources, sinks -------------------------------------------------------------------------


@query("A-01 A-02 A-11", ctes(b.NATIONAL) + "SELECT ts, total FROM nat")
def csv_date_roundtrip(spark, sf):
    path = sinks.write_table(bd.national(spark, sf).select("ts", "total"), scratch_path(spark, "monthly"), "csv")
    return readers.read_csv(spark, path, "ts date, total double")


@query("A-04 B-03", ctes(b.YEARLY_NATIONAL) + "SELECT year, total AS population FROM ynat")
def measure_files(spark, sf):
    path = sinks.write_table(bd.yearly_national(spark, sf).select("year", "total"), scratch_path(spark, "measure"))
    renamed = shaping.rename_positional(spark.read.parquet(path), ["Year", "Count of people"])
    path = sinks.write_table(renamed, scratch_path(spark, "measure"))
    return readers.read_measure(spark, path, "population", "parquet")


@query(
    "A-03 C-01 E-01",
    "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
    "FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1",
)
def pruned_scan(spark, sf):
    rows = bd.table(spark, sf, "orders").select("o_orderdate", "o_totalprice")
    inside = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (
        F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    )
    return rows.where(inside).groupBy(big(F.year("o_orderdate")).alias("year")).agg(
        bd.money("o_totalprice").alias("total")
    )


@query(
    "A-05 A-09 B-05 B-06 B-18",
    ctes(b.METRICS) + "SELECT member || ' ' || model AS \"Model\", round(mape, 4) AS \"MAPE\", round(100 - mape, 4) AS accuracy_percent "
    "FROM mets WHERE split = 'TEST'",
)
def fallback_source(spark, sf):
    primary = readers.read_optional(spark, f"{sf}/national_metrics_not_written.parquet")
    board = b.metrics(spark, sf).where("split = 'TEST'").select(
        F.concat_ws(" ", "member", "model").alias("model"), F.col("mape").alias("test_mape")
    )
    aliases = {"Model": ["model"], "MAPE": ["test_mape", "val_mape"]}
    found = readers.first_available([(primary, {}), (board, aliases)], ["Model", "MAPE"])
    return found.select("Model", rd("MAPE").alias("MAPE"), rd(nm.accuracy(F.col("MAPE"))).alias("accuracy_percent"))


@query(
    "A-06",
    r"""
WITH t AS (SELECT page_id, unnest(l) AS body, unnest(range(len(l))) AS table_id FROM
    (SELECT page_id, regexp_extract_all(html, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul>', 1) AS l FROM pages)),
r AS (SELECT page_id, table_id, unnest(l) AS body, unnest(range(len(l))) AS row_no FROM
    (SELECT page_id, table_id, regexp_extract_all(body, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS l FROM t)),
c AS (SELECT page_id, table_id, row_no, regexp_extract_all(body, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1) AS l FROM r)
SELECT page_id, table_id, row_no, CAST(len(l) AS BIGINT) AS n_cells,
  array_to_string(list_transform(l, lambda x: trim(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
    '&nbsp;', ' '), '&#160;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&minus;', '−'), '&amp;', '&'))), '|') AS cells FROM c
""",
)
def page_list_rows(spark, sf):
    rows = pages.extract_rows(bd.table(spark, sf, "pages"), "page_id", "html", table="ul", row="li", cell="a")
    return rows.select(
        "page_id", big("table_id").alias("table_id"), big("row_no").alias("row_no"),
        big(F.size("cells")).alias("n_cells"), F.concat_ws("|", "cells").alias("cells"),
    )


@query(
    "A-07 A-08",
    """
WITH spans AS (SELECT o_custkey, count(*) AS n_years, min(y) AS min_year, max(y) AS max_year
    FROM (SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders) GROUP BY 1 HAVING count(*) >= 3),
h AS (SELECT 'history' AS role, * FROM spans WHERE min_year <= 1995 AND max_year BETWEEN 2000 AND 2000 ORDER BY o_custkey DESC LIMIT 1),
f AS (SELECT 'forecast' AS role, * FROM spans WHERE max_year >= 2001 ORDER BY o_custkey DESC LIMIT 1)
SELECT role, o_custkey AS table_key, CAST(min_year AS BIGINT) AS min_year, CAST(max_year AS BIGINT) AS max_year
FROM (SELECT * FROM h UNION ALL SELECT * FROM f)
""",
)
def year_table_choice(spark, sf):
    """Each customer's yearly totals are one candidate table of text cells."""
    cells = (
        bd.table(spark, sf, "orders")
        .groupBy("o_custkey", F.year("o_orderdate").alias("y"))
        .agg(bd.money("o_totalprice").alias("v"))
        .select(F.col("o_custkey").alias("table_key"), F.format_string("%,d", "y").alias("year_text"), F.col("v").cast("string").alias("value_text"))
    )
    tables = readers.table_or_pages(spark, None, "year_text string, value_text string", cells)
    spans = pages.table_spans(tables, ["table_key"], "year_text")
    chosen = pages.choose_tables(spans, ["table_key"], history_from=1995, history_to=(2000, 2000), forecast_to=2001)
    return chosen.select("role", "table_key", big("min_year").alias("min_year"), big("max_year").alias("max_year"))


@query(
    "A-06",
    r"""
WITH t AS (SELECT page_id, unnest(l) AS body, unnest(range(len(l))) AS table_id FROM
    (SELECT page_id, regexp_extract_all(html, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul>', 1) AS l FROM pages)),
r AS (SELECT page_id, table_id, unnest(l) AS body, unnest(range(len(l))) AS row_no FROM
    (SELECT page_id, table_id, regexp_extract_all(body, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS l FROM t)),
c AS (SELECT page_id, table_id, row_no, regexp_extract_all(body, '(?is)<a(?:\s[^>]*)?>(.*?)</a>', 1) AS l FROM r)
SELECT page_id, table_id, CAST(0 AS BIGINT) AS depth, row_no,
  array_to_string(list_transform(l, lambda x: trim(regexp_replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))), '|') AS cells FROM c
""",
)
def page_list_grid(spark, sf):
    """Lists of links as grids, by the markup reader that also takes spans, nesting and broken markup."""
    rows = grids.extract_grids(bd.table(spark, sf, "pages"), "page_id", "html", container="ul", row="li", cells={"a": False})
    return rows.select("page_id", big("table_id").alias("table_id"), big("depth").alias("depth"), big("row_no").alias("row_no"), F.concat_ws("|", "cells").alias("cells"))


@query(
    "A-06 A-07 A-08",
    ctes(
        b.YEARLY,
        "parts AS (SELECT *, year > (SELECT max(year) FROM yearly) - 3 AS late FROM yearly)",
        "usable AS (SELECT member, late FROM parts GROUP BY 1, 2 HAVING count(*) >= 3)",
        "rows_ AS (SELECT member, year, total FROM parts JOIN usable USING (member, late))",
        "stepped AS (SELECT member, year, total, coalesce(lead(total) OVER w - total, total - lag(total) OVER w) AS d, count(*) OVER (PARTITION BY member) AS n FROM rows_ WINDOW w AS (PARTITION BY member ORDER BY year))",
    )
    + "SELECT member, CAST(make_date(year, CAST(m AS INT), 1) AS DATE) AS ts, round((total + (m - 1) / 12.0::DOUBLE * d) / 7, 4) AS weekly FROM stepped, range(1, 13) AS t(m) WHERE n >= 2",
)
def page_tables_to_panel(spark, sf):
    """A page per member with yearly figures in nested tables with spans, brought back to a monthly panel: grids, candidates, choice, months."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    late = F.col("year") > one_value(yearly, F.max("year")) - 3
    line = F.struct("year", F.format_string("<td>%d<td> <b>%s</b>&nbsp;<td>n/a", "year", F.format_number("total", 2)).alias("cells"))
    lines = yearly.groupBy("member", late.alias("late")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    heads = "<thead><tr><th rowspan=2>Era<th rowspan=2>Year<th colspan=2>Counts</tr><tr><th> Population <th>Share %</tr></thead><tbody>"
    era = F.when(F.col("late"), "to come").otherwise("until now")
    body = F.concat(F.format_string("<tr><td rowspan=%d>%s", F.size("lines"), era), F.array_join(F.transform("lines", lambda x: x["cells"]), "</tr><tr>"))
    inner = F.concat(F.lit("<table class=figures>" + heads), body, F.lit("</tbody></table>"))
    html = F.concat(F.lit("<html><table><tr><td>Year<td>"), F.array_join(F.array_sort(F.collect_list(inner)), "<td>"), F.lit("</table>"))
    stored = lines.groupBy("member").agg(html.alias("html"))
    rows = checkpointed(grids.extract_grids(stored, "member", "html"))
    tables = readers.table_or_pages(spark, None, "year_text string, value_text string", pages.year_tables(rows, "member"))
    chosen = pages.choose_tables_per_group(pages.table_spans(tables, ["member", "table_id"], "year_text"), ["member"], ["table_id"])
    found = tables.join(chosen, ["member", "table_id"]).select("member", tx.to_number(F.col("year_text")).cast("int").alias("year"), tx.to_number(F.col("value_text")).alias("total"))
    months = cal.yearly_to_monthly(found, "member", "year", ["total"])
    return months.select("member", "ts", rd(F.col("total") / 7).alias("weekly"))


@query(
    "A-10 B-19 I-15",
    ctes(b.NATIONAL, "rates(season, item, rate) AS (VALUES ('Yala', 'rice', 100.0), ('Yala', 'maize', 12.5), ('Maha', 'rice', 110.0))")
    + "SELECT ts, season, item, CAST(rate AS DOUBLE) AS rate, round(total * CAST(rate AS DOUBLE), 4) AS demand FROM "
    "(SELECT *, CASE WHEN month(ts) BETWEEN 5 AND 9 THEN 'Yala' ELSE 'Maha' END AS season FROM nat) JOIN rates USING (season)",
)
def seasonal_rates(spark, sf):
    rows = [("Yala", "rice", 100.0), ("Yala", "maize", 12.5), ("Maha", "rice", 110.0)]
    rates = readers.rows_to_table(spark, rows, "season string, item string, rate double")
    monthly = bd.national(spark, sf).withColumn("season", tm.season(F.col("ts")))
    return monthly.join(rates, "season").select("ts", "season", "item", "rate", rd(F.col("total") * F.col("rate"), 4).alias("demand"))


@query(
    "A-12 J-13 H-05",
    ctes(
        b.PANEL,
        b.NATIONAL,
        "d AS (SELECT member, abs(total - lag(total) OVER w) AS d1, abs(total - lag(total, 12) OVER w) AS d12 FROM panel WINDOW w AS (PARTITION BY member ORDER BY ts))",
        "m AS (SELECT member, avg(d1) AS mae, avg(d12) AS mae12 FROM d GROUP BY 1)",
        "asia AS (SELECT n_name AS member FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')",
        "tot AS (SELECT avg(x) AS mae FROM (SELECT abs(total - lag(total) OVER (ORDER BY ts)) AS x FROM nat))",
    )
    + "SELECT member, round(mae, 4) AS mae, 'first' AS notes FROM m WHERE member NOT IN (SELECT member FROM asia) UNION ALL "
    "SELECT member, round(mae12, 4), 'replaced' FROM m WHERE member IN (SELECT member FROM asia) UNION ALL SELECT 'TOTAL', round(mae, 4), 'added' FROM tot",
)
def metric_store_upsert(spark, sf):
    panel, total = bd.panel_and_total(spark, sf)

    def change(df, steps, note):
        return df.withColumn("_d", F.abs(ft.difference("total", "member", "ts", steps))).groupBy("member").agg(
            rd(F.avg("_d")).alias("mae"), F.lit(note).alias("notes")
        )

    region = bd.table(spark, sf, "region").where("r_name = 'ASIA'")
    asia = bd.table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    some = panel.join(asia.select(F.col("n_name").alias("member")), "member", "left_semi")
    store = sinks.KeyedStore(spark, scratch_path(spark, "metrics"), "member")
    store.put(change(panel, 1, "first"))
    store.put(change(some, 12, "replaced").unionByName(change(total, 1, "added")))
    return store.read()


@query(
    "A-13",
    ctes(b.YEARLY) + "SELECT CAST(to_json({'member': member, 'year': year, 'total': CAST(floor(total) AS BIGINT)}) AS VARCHAR) AS record FROM yearly",
)
def json_records(spark, sf):
    return sinks.to_records(bd.yearly_members(spark, sf).select("member", "year", big(F.floor("total")).alias("total")))


@query(
    "A-14 J-12 J-16 C-12",
    ctes(
        b.YEARLY,
        "model AS (SELECT member, regr_intercept(total, year) AS b0, regr_slope(total, year) AS b1 FROM yearly GROUP BY 1)",
        "kept AS (SELECT * FROM model WHERE b1 > 0)",
    )
    + "SELECT member, year, round(b0 + b1 * year, 0) AS predicted FROM yearly JOIN kept USING (member)",
)
def stored_coefficients(spark, sf):
    """Members with a rising line have a model; the others are skipped when scoring."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    fit = tr.linear_trend(yearly, "member", "year", "total", F.lit(True)).where("slope > 0")
    coefs = sinks.load_model(spark, sinks.save_model(fit, scratch_path(spark, "model")))
    modelled = yearly.join(coefs.select("member"), "member", "left_semi")
    return tr.predict_line(modelled, coefs, "member", "year").select("member", "year", rd("predicted", 0).alias("predicted"))


@query(
    "A-15",
    ctes(b.METRICS) + "SELECT member, model, split, round(mape, 4) AS mape, f AS format FROM mets, (VALUES ('csv'), ('parquet')) AS t(f)",
)
def formats_copy(spark, sf):
    mets = b.metrics(spark, sf).select("member", "model", "split", rd("mape").alias("mape"))
    paths = sinks.write_formats(mets, scratch_path(spark, "report"))
    schema = "member string, model string, split string, mape double"
    back = {"csv": readers.read_csv(spark, paths["csv"], schema), "parquet": spark.read.parquet(paths["parquet"])}
    return back["csv"].withColumn("format", F.lit("csv")).unionByName(back["parquet"].withColumn("format", F.lit("parquet")))


@query(
    "A-16 I-21 K-04 G-03 F-14",
    ctes(b.METRICS, "r AS (SELECT *, row_number() OVER (ORDER BY 100 - mape DESC, member, model) AS rk FROM mets WHERE split = 'TEST')")
    + "SELECT '| ' || rk || ' | ' || member || ' | ' || model || ' | ' || format('{:,}', CAST(round_even(rmse, 0) AS BIGINT)) || ' | ' || "
    "format('{:.2f}', mape) || '% |' AS line FROM r",
)
def report_rows(spark, sf):
    test = b.metrics(spark, sf).where("split = 'TEST'")
    ranked = ranking.global_rank(test, [F.desc(nm.accuracy(F.col("mape"))), F.col("member"), F.col("model")])
    cells = [F.col("rank").cast("string"), F.col("member"), F.col("model"), tx.thousands(F.col("rmse")), tx.percent(F.col("mape") / 100, 2)]
    return sinks.report_lines(ranked, cells, [F.col("rank")])


# -- projections -----------------------------------------------------------------------------------


@query(
    "B-01 B-02 B-07 B-08 B-09 B-14 B-15",
    "SELECT c_custkey AS key, 'CUSTOMER' AS level, c_mktsegment AS segment, CAST(trunc(c_acctbal) AS BIGINT) AS balance, "
    "CAST(0.0 AS DOUBLE) AS growth FROM customer",
)
def column_shaping(spark, sf):
    df = bd.table(spark, sf, "customer").withColumnsRenamed({"c_custkey": "key", "c_mktsegment": "segment", "c_acctbal": "balance"})
    features = shaping.exclude(df, "c_name", ["c_nationkey"])
    df = df.drop("c_name").withColumn("balance", nm.truncate(F.col("balance")))
    df = shaping.insert_column(shaping.keep_available(df, [*features, "not_there"]), 1, "level", F.lit("CUSTOMER"))
    return shaping.reindex_columns(df, ["key", "level", "segment", "balance", "growth"], fill=0.0)


_HEADING = "' ' || p_type || ' % (' || p_brand || ')/' || p_name || '. '"


@query(
    "B-04 I-02",
    f"""
SELECT trim(regexp_replace(regexp_replace(replace(replace(trim({_HEADING}), '''', ''), '%', 'Percent'), '[ ()/\\-,.]', '_', 'g'), '_+', '_', 'g'), '_')
  AS heading, count(*) AS n_parts FROM part GROUP BY 1
""",
)
def heading_cleanup(spark, sf):
    raw = F.concat(F.lit(" "), "p_type", F.lit(" % ("), "p_brand", F.lit(")/"), "p_name", F.lit(". "))
    return bd.table(spark, sf, "part").groupBy(tx.clean_name_col(raw).alias("heading")).agg(F.count(F.lit(1)).alias("n_parts"))


@query(
    "B-11 B-12",
    ctes(b.NATIONAL, b.DRIVERS_SQL) + "SELECT ts, round(total / 62710.0, 6) AS density, round(total * (birth_rate * 100 / 100.0), 4) AS urban, "
    "round(total - total * (birth_rate * 100 / 100.0), 4) AS rural FROM (SELECT ts, total FROM nat) JOIN drv USING (ts)",
)
def density_and_urban(spark, sf):
    """The average discount serves as the urban percentage."""
    wide = bd.national(spark, sf).join(bd.drivers(spark, sf), "ts")
    urban = nm.part_of(F.col("total"), F.col("birth_rate") * 100)
    return wide.select("ts", rd(nm.density(F.col("total")), 6).alias("density"), rd(urban).alias("urban"), rd(F.col("total") - urban).alias("rural"))


@query(
    "B-13 F-15 G-06",
    ctes(b.PANEL, b.NATIONAL)
    + "SELECT member, max_by(ts, ts) AS last_ts, round(max_by(total, ts), 4) AS last_total, round(min_by(total, ts), 4) AS first_total, "
    "round(max_by(prev, ts), 4) AS second_last, (SELECT max_by(total, ts) FROM nat) AS last_national FROM "
    "(SELECT *, lag(total) OVER (PARTITION BY member ORDER BY ts) AS prev FROM panel) GROUP BY member",
)
def last_value_columns(spark, sf):
    filled, total = bd.panel_and_total(spark, sf)
    panel = ft.lags(filled, "member", "ts", {"prev": ("total", 1)})
    held = fc.last_known(total, "ts", ["total"])["total"]
    ends = panel.groupBy("member").agg(
        F.max("ts").alias("last_ts"), rd(F.max_by("total", "ts")).alias("last_total"),
        rd(F.min_by("total", "ts")).alias("first_total"), rd(F.max_by("prev", "ts")).alias("second_last"),
    )
    return ends.withColumn("last_national", held)


@query(
    "B-16 K-01",
    ctes(b.NATIONAL) + "SELECT ts, CAST(month(ts) BETWEEN 5 AND 9 AS INT) AS \"season_Yala\", CAST(month(ts) NOT BETWEEN 5 AND 9 AS INT) AS \"season_Maha\" FROM nat",
)
def season_one_hot(spark, sf):
    tagged = bd.national(spark, sf).select("ts", tm.season(F.col("ts")).alias("season"))
    return shaping.one_hot(tagged, "season", list(tm.SEASON_BY_MONTH))


@query(
    "B-17 J-04 E-25",
    ctes(b.YEARLY, b.YEARLY_NATIONAL)
    + "SELECT member, year, round(y.total / n.total, 8) AS proportion FROM yearly y LEFT JOIN ynat n USING (year)",
)
def member_share(spark, sf):
    yearly, total = bd.members_and_total(spark, sf)
    wide = yearly.join(total.select("year", F.col("total").alias("grand")), "year", "left")
    return ft.proportion(wide, "total", "grand").select("member", "year", rd("proportion", 8).alias("proportion"))


@query(
    "B-20",
    ctes(b.PREDICTIONS) + "SELECT member, model, ts, round(predicted - actual, 4) AS error, round(abs(predicted - actual), 4) AS abs_error, "
    "round(abs(predicted - actual) / nullif(actual, 0) * 100, 4) AS ape FROM preds",
)
def residual_columns(spark, sf):
    out = mt.residuals(b.predictions(spark, sf))
    return out.select("member", "model", "ts", *[rd(c).alias(c) for c in ("error", "abs_error", "ape")])


# -- filters ---------------------------------------------------------------------------------------


@query(
    "C-02 C-03 C-04 I-01",
    ctes(b.PANEL) + "SELECT member, ts, round(total, 4) AS total FROM panel WHERE lower(member) IN ('nation_3', 'nation_17') AND year(ts) = 1999 AND month(ts) IN (1, 6, 12)",
)
def point_filter(spark, sf):
    panel = bd.filled_panel(spark, sf)
    wanted = [F.lower(F.lit(x)) for x in ("Nation_3", "nation_17")]
    match = F.lower("member").isin(*wanted) & (F.year("ts") == 1999) & F.month("ts").isin(1, 6, 12)
    return panel.where(match).select("member", "ts", rd("total").alias("total"))


@query(
    "C-05 C-06",
    ctes(b.CELLS, b.GAPS, b.DRIVERS_SQL)
    + "SELECT member, count(*) AS n_rows, count(CASE WHEN total IS NOT NULL THEN 1 END) AS with_total, "
    "count(CASE WHEN total IS NOT NULL AND rural IS NOT NULL AND urban IS NOT NULL THEN 1 END) AS complete FROM gaps LEFT JOIN drv USING (ts) GROUP BY 1",
)
def complete_rows(spark, sf):
    wide = bd.member_panel(spark, sf).join(bd.drivers(spark, sf), "ts", "left")

    def count(df, name):
        return df.groupBy("member").agg(F.count(F.lit(1)).alias(name))

    return joins.join_chain(
        count(wide, "n_rows"),
        [count(shaping.drop_incomplete(wide, ["total"]), "with_total"), count(shaping.drop_incomplete(wide), "complete")],
        "member",
        "left",
    )


@query(
    "C-07 I-24",
    ctes(b.CELLS, b.GAPS) + "SELECT member, count(*) AS n_valid FROM gaps WHERE total IS NOT NULL GROUP BY 1",
)
def valid_predictions(spark, sf):
    """Months without orders carry NaN here, as a model that failed would."""
    nan = F.coalesce(F.col("total"), F.lit(float("nan")))
    preds = bd.member_panel(spark, sf).withColumn("predicted", nan)
    return preds.where(nm.is_valid(F.col("predicted")) & nm.is_finite(F.col("predicted"))).groupBy("member").agg(
        F.count(F.lit(1)).alias("n_valid")
    )


@query(
    "C-08 M-20 I-12",
    ctes(b.YEARLY)
    + "SELECT * FROM (SELECT member, CAST(make_date(year + 1, m, 1) AS DATE) AS ts, total AS predicted FROM yearly, range(1, 13) AS t(m) WHERE year = (SELECT max(year) FROM yearly)) "
    "WHERE ts >= make_date((SELECT max(year) FROM yearly) + 1, 1, 31)",
)
def flat_months_after_cutoff(spark, sf):
    """Last year's value carried into the next year, from the month after the last observation's year end."""
    yearly, until = bd.yearly_members(spark, sf), bd.last_complete_year(spark, sf)
    last = yearly.where(F.col("year") == until).withColumn("year", F.col("year") + 1)
    flat = cal.spread_flat(last.withColumnRenamed("total", "predicted"), "member", "year", "predicted")
    return cal.after_last_year(flat, until)


@query("C-09", ctes(b.PANEL) + "SELECT member, CAST(year(ts) AS BIGINT) AS year, round(total, 4) AS total FROM panel WHERE month(ts) = 12")
def december_rows(spark, sf):
    panel = bd.filled_panel(spark, sf).where(F.month("ts") == 12)
    return panel.select("member", big(F.year("ts")).alias("year"), rd("total").alias("total"))


@query(
    "C-10",
    ctes(b.CELLS) + "SELECT member, count(*) AS n_rows FROM cells GROUP BY 1 HAVING count(*) >= 78",
)
def long_series_only(spark, sf):
    kept = splits.min_size(checkpointed(bd.member_cells(spark, sf)), "member", 78)
    return kept.groupBy("member").agg(F.count(F.lit(1)).alias("n_rows"))


@query("C-11", ctes(b.YEARLY) + "SELECT member, year, total FROM yearly")
def guarded_rows(spark, sf):
    yearly = checkpointed(bd.yearly_members(spark, sf))
    return splits.require_rows(yearly, 10, "not enough rows")


@query(
    "C-13 H-04",
    ctes(b.CELLS, b.GAPS)
    + ", f AS (SELECT member, CAST(unnest(generate_series(max(ts) - INTERVAL 2 MONTH, max(ts) + INTERVAL 3 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ts FROM gaps GROUP BY 1) "
    "SELECT member, ts, CAST(NULL AS DOUBLE) AS total FROM f WHERE ts > (SELECT max(ts) FROM cells)",
)
def future_part(spark, sf):
    """History extended by a horizon with NULL values; only months after the last observation are kept."""
    cells = checkpointed(bd.member_cells(spark, sf))
    history = cal.regularise(cells, "member")
    last = one_value(cells, F.max("ts"))
    members = history.select("member").distinct()
    future = members.select("member", cal.month_grid(F.add_months(last, 1), F.add_months(last, 3)).alias("ts"), F.lit(None).cast("double").alias("total"))
    return history.unionByName(future).where(F.col("ts") > last)


@query(
    "C-14 I-13",
    ctes(b.CELLS) + "SELECT member, ts, total FROM cells WHERE year(ts) <= " + b.LAST_YEAR,
)
def complete_years_only(spark, sf):
    return bd.member_cells(spark, sf).where(F.year("ts") <= bd.last_complete_year(spark, sf))


# -- plain joins -----------------------------------------------------------------------------------


@query(
    "J-01",
    ctes(b.YEARLY_NATIONAL, b.YEARLY_DRIVERS, "ev AS (SELECT CAST(year(ts) AS INT) AS year, count(*) AS n_events FROM events GROUP BY 1)")
    + "SELECT year, total, round(birth_rate, 8) AS birth_rate, round(death_rate, 8) AS death_rate, n_events FROM ynat LEFT JOIN ydrv USING (year) LEFT JOIN ev USING (year)",
)
def left_join_chain(spark, sf):
    drv = checkpointed(bd.yearly_drivers(spark, sf))
    events = bd.table(spark, sf, "events").groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))
    parts = [drv.select("year", rd("birth_rate", 8).alias("birth_rate")), drv.select("year", rd("death_rate", 8).alias("death_rate")), events]
    return joins.join_chain(bd.yearly_national(spark, sf).select("year", "total"), parts, "year", "left")


@query(
    "J-02 G-01",
    ctes(b.YEARLY_NATIONAL, b.YEARLY_DRIVERS, "ev AS (SELECT CAST(year(ts) AS INT) AS year, count(*) AS n_events FROM events GROUP BY 1)")
    + "SELECT year, total, round(density, 8) AS density, n_events FROM ynat FULL JOIN ydrv USING (year) FULL JOIN ev USING (year)",
)
def outer_join_chain(spark, sf):
    drv = bd.yearly_drivers(spark, sf).select("year", rd("density", 8).alias("density"))
    events = bd.table(spark, sf, "events").groupBy(F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("n_events"))
    return joins.join_chain(bd.yearly_national(spark, sf).select("year", "total"), [drv, events], "year", "full").orderBy("year")


@query(
    "J-03",
    ctes(b.MEMBER_WIDE) + "SELECT member, ts, round(total, 4) AS total, national, round(birth_rate, 8) AS birth_rate, rural, urban FROM wide",
)
def panel_with_drivers(spark, sf):
    panel, total = bd.panel_and_total(spark, sf)
    nat = total.select("ts", F.col("total").alias("national"))
    wide = panel.join(nat, "ts", "left").join(bd.drivers(spark, sf), "ts", "left")
    return wide.select("member", "ts", rd("total").alias("total"), "national", rd("birth_rate", 8).alias("birth_rate"), "rural", "urban")


@query(
    "J-05",
    ctes(b.CELLS) + "SELECT a.member, a.ts, a.total AS actual, p.total AS predicted FROM cells a JOIN cells p ON a.member = p.member AND p.ts = a.ts - INTERVAL 12 MONTH",
)
def aligned_forecast(spark, sf):
    """Last year's month as the forecast, aligned with the actual by an inner join on the date."""
    cells = checkpointed(bd.member_cells(spark, sf))
    actual = cells.withColumnRenamed("total", "actual")
    forecast = cells.select("member", F.add_months("ts", 12).alias("ts"), F.col("total").alias("predicted"))
    return actual.join(forecast, ["member", "ts"])


_REQ = "req AS (SELECT o_orderkey, n_name AS member, CAST(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 4 = 0 THEN 400 ELSE 0 END AS DATE) AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def _requests(spark, sf):
    """Every order asks for its nation's series at its own date, every fourth 400 days earlier, so that some ask before the first quarter."""
    day = F.date_sub(F.to_date("o_orderdate"), F.when(F.col("o_orderkey") % 4 == 0, 400).otherwise(0))
    orders = bd.table(spark, sf, "orders").select("o_orderkey", "o_custkey", day.alias("ts"))
    members = bd.customer_members(spark, sf)
    return orders.join(members, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "member", "ts")


_QUARTERS = (
    "quarters AS (SELECT n_name AS member, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ts, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"
)


def _quarters(spark, sf):
    cells = bd.member_cells(spark, sf)
    exact = bd.money("total")
    return cells.groupBy("member", F.to_date(F.trunc("ts", "quarter")).alias("ts")).agg(exact.alias("total"))


@query(
    "J-06",
    ctes(_REQ, _QUARTERS, "u AS (SELECT DISTINCT member, ts FROM req)")
    + ", hit AS (SELECT u.member, u.ts, arg_min(q.ts, abs(q.ts - u.ts) * 2 + CASE WHEN q.ts > u.ts THEN 1 ELSE 0 END) AS matched_ts, "
    "arg_min(q.total, abs(q.ts - u.ts) * 2 + CASE WHEN q.ts > u.ts THEN 1 ELSE 0 END) AS total FROM u JOIN quarters q ON q.member = u.member GROUP BY 1, 2) "
    "SELECT o_orderkey, member, ts, matched_ts, total FROM req LEFT JOIN hit USING (member, ts)",
)
def nearest_asof(spark, sf):
    return joins.asof_nearest(_requests(spark, sf), _quarters(spark, sf), "member", "ts", ["total"]).select(
        "o_orderkey", "member", "ts", "matched_ts", "total"
    )


@query(
    "J-07",
    ctes(_REQ, _QUARTERS, "u AS (SELECT DISTINCT member, ts FROM req)")
    + ", back AS (SELECT u.member, u.ts, max(q.ts) AS matched_ts FROM u JOIN quarters q ON q.member = u.member AND q.ts <= u.ts GROUP BY 1, 2), "
    "fst AS (SELECT member, min(ts) AS f FROM quarters GROUP BY 1), "
    "hit AS (SELECT u.member, u.ts, coalesce(matched_ts, f) AS matched_ts FROM u LEFT JOIN back USING (member, ts) JOIN fst USING (member)) "
    "SELECT o_orderkey, r.member, r.ts, matched_ts, q.total FROM req r LEFT JOIN hit h ON h.member = r.member AND h.ts = r.ts LEFT JOIN quarters q ON q.member = r.member AND q.ts = matched_ts",
)
def backward_asof(spark, sf):
    return joins.asof_backward(_requests(spark, sf), _quarters(spark, sf), "member", "ts", ["total"]).select(
        "o_orderkey", "member", "ts", "matched_ts", "total"
    )


@query(
    "J-08 M-19",
    ctes(b.CELLS)
    + "SELECT member, ts, CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, round(year(ts) + (month(ts) - 1) / 12.0::DOUBLE, 8) AS fractional_year FROM "
    "(SELECT member, CAST(unnest(generate_series((SELECT max(ts) FROM cells) + INTERVAL 1 MONTH, (SELECT max(ts) FROM cells) + INTERVAL 24 MONTH, INTERVAL 1 MONTH)) AS DATE) AS ts FROM (SELECT DISTINCT member FROM cells))",
)
def member_calendar(spark, sf):
    cells = checkpointed(bd.member_cells(spark, sf))
    last = one_value(cells, F.max("ts"))
    grid = cal.month_horizon(cells.select("member").distinct(), F.add_months(last, 1), F.add_months(last, 24))
    return grid.select("member", "ts", big("year").alias("year"), big("month").alias("month"), rd("fractional_year", 8).alias("fractional_year"))


@query(
    "J-14 F-18",
    ctes(b.YEARLY, "folds AS (SELECT member, year AS fold FROM yearly WHERE year >= 1997)")
    + "SELECT member, CAST(fold AS BIGINT) AS fold, count(*) AS train_rows, round(avg(total), 4) AS train_mean FROM folds JOIN yearly USING (member) WHERE year < fold GROUP BY 1, 2",
)
def fold_training_rows(spark, sf):
    stats = {"train_rows": F.count(F.lit(1)), "train_mean": F.avg("total")}
    folds = bt.expanding(bd.yearly_members(spark, sf), "member", "year", stats).where("year >= 1997")
    return folds.select("member", big("year").alias("fold"), "train_rows", rd("train_mean").alias("train_mean"))


@query(
    "J-15 F-16",
    ctes(b.YEARLY)
    + "SELECT member, year, total, lead(total) OVER w AS next_total, round(lead(total) OVER w - total, 4) AS step, round(total - lag(total) OVER w, 4) AS back FROM yearly WINDOW w AS (PARTITION BY member ORDER BY year)",
)
def consecutive_pairs(spark, sf):
    w = series_window("member", "year")
    nxt = F.lead("total").over(w)
    return bd.yearly_members(spark, sf).select(
        "member", "year", "total", nxt.alias("next_total"), rd(nxt - F.col("total")).alias("step"),
        rd(ft.difference("total", "member", "year")).alias("back"),
    )


@query(
    "J-17",
    ctes(b.PREDICTIONS)
    + 'SELECT member, ts, round(max(CASE WHEN model = \'NAIVE\' THEN predicted END), 4) AS "NAIVE", round(max(CASE WHEN model = \'TREND\' THEN predicted END), 4) AS "TREND" FROM preds GROUP BY 1, 2',
)
def pipelines_side_by_side(spark, sf):
    preds = b.predictions(spark, sf)
    parts = {m: preds.where(F.col("model") == m) for m in ("NAIVE", "TREND")}
    wide = fc.compare_pipelines(parts, ["member", "ts"], "predicted")
    return wide.select("member", "ts", rd("NAIVE").alias("NAIVE"), rd("TREND").alias("TREND"))


# -- sorts and set operations ----------------------------------------------------------------------


@query(
    "G-02 G-04",
    ctes(b.CELLS) + "SELECT member, ts, total FROM cells ORDER BY total DESC, member, ts LIMIT 20",
)
def first_rows(spark, sf):
    return ranking.top_k(bd.member_cells(spark, sf), [F.desc("total"), F.col("member"), F.col("ts")], 20)


@query(
    "G-05",
    ctes(b.CELLS, "t AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY total DESC, ts) AS hi, row_number() OVER (PARTITION BY member ORDER BY total, ts) AS lo FROM cells)")
    + "SELECT member, ts, total, hi AS rank, 'top' AS side FROM t WHERE hi <= 5 UNION ALL SELECT member, ts, total, lo, 'bottom' FROM t WHERE lo <= 5",
)
def top_and_bottom_months(spark, sf):
    cells = checkpointed(bd.member_cells(spark, sf))
    top = ranking.top_k_per_group(cells, "member", [F.desc("total"), F.col("ts")], 5).withColumn("side", F.lit("top"))
    low = ranking.top_k_per_group(cells, "member", [F.col("total"), F.col("ts")], 5).withColumn("side", F.lit("bottom"))
    return top.unionByName(low).withColumn("rank", big("rank"))


@query(
    "H-01 H-02",
    ctes(b.YEARLY)
    + "SELECT member, year, total, 'history' AS source FROM yearly WHERE year < (SELECT max(year) FROM yearly) UNION ALL "
    "SELECT member, year + 1, total, 'forecast' FROM yearly WHERE year >= (SELECT max(year) - 1 FROM yearly)",
)
def history_then_forecast(spark, sf):
    """Forecast rows replace history rows of the same member and year."""
    yearly = checkpointed(bd.yearly_members(spark, sf))
    history = yearly.withColumn("source", F.lit("history"))
    forecast = yearly.where(F.col("year") >= one_value(yearly, F.max("year")) - 1).select("member", (F.col("year") + 1).alias("year"), "total", F.lit("forecast").alias("source"))
    return joins.latest_source_wins([history, forecast], ["member", "year"])


@query(
    "H-03",
    ctes(b.SPLIT3) + "SELECT member, count(*) AS n_rows, round(avg(total), 4) AS mean_total FROM parts WHERE split IN ('TRAIN', 'VAL') GROUP BY 1",
)
def refit_rows(spark, sf):
    rows = splits.three_way(bd.filled_panel(spark, sf), "member", "ts").where(F.col("split").isin("TRAIN", "VAL"))
    return rows.groupBy("member").agg(F.count(F.lit(1)).alias("n_rows"), rd(F.avg("total")).alias("mean_total"))


# -- scalar functions ------------------------------------------------------------------------------


@query(
    "I-03 I-04",
    "SELECT o_orderkey, o_totalprice AS value, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN NULL ELSE -o_totalprice END AS negative, "
    "CAST(NULL AS DOUBLE) AS status_number, o_totalprice AS coerced FROM orders",
)
def numeric_text(spark, sf):
    """Order totals written as text with thousands commas, a typographic minus, percent signs and missing marks."""
    orders = bd.table(spark, sf, "orders")
    grouped = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    missing = F.when(F.col("o_orderpriority") == "1-URGENT", "").when(F.col("o_orderpriority") == "5-LOW", "None")
    minus = F.coalesce(missing, F.concat(F.lit(tx.MINUS_SIGN + " "), grouped, F.lit(" %")))
    return orders.select(
        "o_orderkey", tx.to_number(grouped).alias("value"), tx.to_number(minus).alias("negative"),
        tx.to_number(F.col("o_orderpriority")).alias("status_number"), tx.coerce(F.col("o_totalprice").cast("string")).alias("coerced"),
    )


@query(
    "I-05 I-06 I-07 I-08 I-09 I-10 I-11 I-12 I-23",
    """
SELECT o_orderkey, make_date(CAST(year(d) AS INT), 12, 31) AS year_end, CAST(date_trunc('month', d) AS DATE) AS first_day, d AS parsed,
  CAST(year(d) AS BIGINT) AS year, CAST(month(d) AS BIGINT) AS month, round(year(d) + (month(d) - 1) / 12.0::DOUBLE, 8) AS fractional_year,
  CAST((2001 - year(d)) * 12 + 8 - month(d) AS BIGINT) AS steps, round((DATE '2001-08-01' - d) / 30.44::DOUBLE, 6) AS months_ahead,
  CAST(d + INTERVAL 1 MONTH AS DATE) AS next_month, strftime(d, '%Y-%m-01') AS month_text
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
""",
)
def calendar_functions(spark, sf):
    d, end = F.col("d"), F.lit("2001-08-01").cast("date")
    return bd.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d")).select(
        "o_orderkey",
        tm.year_end(F.year(d)).alias("year_end"),
        tm.first_of_month(F.year(d), F.month(d)).alias("first_day"),
        tm.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("parsed"),
        big(F.year(d)).alias("year"),
        big(F.month(d)).alias("month"),
        rd(tm.fractional_year(d), 8).alias("fractional_year"),
        big(tm.month_steps(end, d)).alias("steps"),
        rd(tm.months_ahead(end, d), 6).alias("months_ahead"),
        F.add_months(d, 1).alias("next_month"),
        tm.month_text(F.year(d), F.month(d)).alias("month_text"),
    )


@query(
    "I-16 I-17 I-18 I-19 I-20 I-26",
    """
SELECT c_custkey, round(c_acctbal * c_acctbal, 2) AS squared, round(sqrt(abs(c_acctbal)), 6) AS root,
  least(greatest(c_acctbal / 20000.0::DOUBLE, 0.01), 0.5) AS clipped,
  CASE WHEN c_nationkey = 0 THEN 0.5 WHEN c_nationkey = 1 THEN 0.01 WHEN c_nationkey = 2 THEN 0.05 ELSE least(greatest(c_acctbal / 20000.0::DOUBLE, 0.01), 0.5) END AS share,
  CAST(round_even(c_acctbal, 0) AS DOUBLE) AS whole, CAST(trunc(c_acctbal) AS BIGINT) AS cut, round(c_acctbal * (1 + 0.008::DOUBLE * 12), 4) AS grown
FROM customer
""",
)
def numeric_functions(spark, sf):
    """Some nations get infinite or missing shares, which the clean-up replaces."""
    v, n = F.col("c_acctbal"), F.col("c_nationkey")
    broken = (
        F.when(n == 0, float("inf")).when(n == 1, float("-inf")).when(n == 2, float("nan")).otherwise(v / 20000.0)
    )
    return bd.table(spark, sf, "customer").select(
        "c_custkey",
        rd(F.pow(v, F.lit(2.0)), 2).alias("squared"),
        rd(F.sqrt(F.abs(v)), 6).alias("root"),
        nm.clip(v / 20000.0, 0.01, 0.5).alias("clipped"),
        nm.clean_share(broken, nm.SHARE_RANGE).alias("share"),
        nm.half_even(v, 0).alias("whole"),
        nm.truncate(v).alias("cut"),
        rd(nm.linear_growth(v, F.lit(12))).alias("grown"),
    )


@query(
    "I-22",
    ctes(b.METRICS) + "SELECT member, CAST(to_json({'model': model, 'rows': n_rows}) AS VARCHAR) AS params FROM mets WHERE split = 'TEST'",
)
def params_as_json(spark, sf):
    test = b.metrics(spark, sf).where("split = 'TEST'")
    return test.select("member", sinks.params_json(F.struct("model", F.col("n_rows").alias("rows"))).alias("params"))


@query(
    "I-25 I-27",
    ctes(b.NATIONAL, b.DRIVERS_SQL, "w AS (SELECT ts, total, urban FROM nat JOIN drv USING (ts))")
    + "SELECT ts, round(total * (SELECT max_by(urban / total, ts) FROM w), 4) AS urban_forecast, CAST(NULL AS DOUBLE) AS median_age FROM w",
)
def ratio_held_at_last(spark, sf):
    wide = checkpointed(bd.national(spark, sf).join(bd.drivers(spark, sf), "ts"))
    held = one_value(wide, F.max_by(F.col("urban") / F.col("total"), "ts"))
    absent = shaping.column_or(wide, "median_age", F.lit(None).cast("double"))
    return wide.select("ts", rd(F.col("total") * held).alias("urban_forecast"), absent.alias("median_age"))


@query(
    "B-10",
    ctes(b.DRIVERS_SQL) + "SELECT ts, round(birth_rate, 8) AS birth_rate, CAST(NULL AS DOUBLE) AS migrants, CAST(NULL AS DOUBLE) AS median_age FROM drv",
)
def required_columns(spark, sf):
    """Columns a model needs but the table lacks are added as NULL."""
    full = shaping.require_numeric(bd.drivers(spark, sf).select("ts", "birth_rate"), ["birth_rate", "migrants", "median_age"])
    return full.withColumn("birth_rate", rd("birth_rate", 8))
