import pytest
from pyspark.sql import functions as F

from seriesloom.session import scratch_path, shared_dir
from seriesloom.sources import pages, readers, sinks

HTML = """<html><table class='x'><tr><th>Year</th><th>Population</th></tr>
<tr><td> 1950 </td><td><b>7,000</b></td></tr><tr><td>1990</td><td>17,000</td></tr><tr><td>2026</td><td>23,000</td></tr></table>
<p>no table</p><TABLE><TR><TH>Population</TH><TH>Year</TH></TR><tr><td>24,000</td><td>2030</td></tr>
<tr><td>25,000</td><td>2040</td></tr><tr><td>26,000</td><td>2050</td></tr></TABLE>
<table><tr><th>Other</th></tr><tr><td>1</td></tr></table></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(1, HTML), (2, "<html>nothing</html>")], "page_id long, html string")
    return pages.extract_rows(df, "page_id", "html")


def test_extract_rows(rows):
    got = {(r.table_id, r.row_no): list(r.cells) for r in rows.collect()}
    assert got[(0, 0)] == ["Year", "Population"] and got[(0, 1)] == ["1950", "7,000"]
    assert got[(1, 3)] == ["26,000", "2050"] and len(got) == 10


def test_choose_history_and_forecast(rows):
    tables = pages.year_tables(rows, "page_id")
    spans = pages.table_spans(tables, ["page_id", "table_id"], "year_text")
    got = {r.role: (r.table_id, r.min_year, r.max_year) for r in pages.choose_tables(spans, ["page_id", "table_id"]).collect()}
    assert got == {"history": (0, 1950, 2026), "forecast": (1, 2030, 2050)}


def test_choice_falls_back(spark):
    spans = spark.createDataFrame([(1, 5, 1960, 2000), (2, 5, 1970, 2010)], "t int, n_years int, min_year int, max_year int")
    got = {r.role: r.t for r in pages.choose_tables(spans, ["t"]).collect()}
    assert got == {"history": 1, "forecast": 2}
    alone = {r.role: r.t for r in pages.choose_tables(spans.where("t = 2"), ["t"]).collect()}
    assert alone == {"history": 2}


def test_named_table(rows):
    t = pages.named_table(rows.where("table_id = 0"), ["Year", "Population"])
    assert t.columns == ["Year", "Population"] and t.count() == 3


def test_readers(spark):
    df = spark.createDataFrame([(2000, 1.5), (2001, 2.5)], "year int, v double")
    path = sinks.write_table(df, scratch_path(spark, "t"), "csv")
    assert readers.read_measure(spark, path, "population").orderBy("year").first() == (2000, 1.5)
    assert readers.read_optional(spark, path + "-absent") is None
    assert readers.read_optional(spark, path, "csv", "year int, v double") is not None
    with pytest.raises(Exception):
        readers.read_csv(spark, sinks.write_table(df.select(F.lit("x").alias("year"), "v"), scratch_path(spark, "bad"), "csv"), "year int, v double").collect()
    with pytest.raises(ValueError):
        readers.first_available([(None, {}), (df, {})], ["nope"])


def test_store_versions(spark):
    store = sinks.KeyedStore(spark, scratch_path(spark, "store"), "k")
    assert store.version() == 0 and store.read() is None
    store.put(spark.createDataFrame([("b", 1), ("a", 1)], "k string, v int"))
    store.put(spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"))
    assert store.version() == 2
    assert sorted(tuple(r) for r in store.read().collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_formats_and_records(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    paths = sinks.write_formats(df, scratch_path(spark, "f"))
    assert spark.read.parquet(paths["parquet"]).first() == ("a", 1)
    assert sinks.to_records(df).first().record == '{"k":"a","v":1}'


def test_shared_dir_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (configured or spark.sparkContext.getCheckpointDir() or shared_dir(spark))


def test_workers_get_the_package(tmp_path):
    """A query solved in numpy runs from a folder that does not hold the package."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "job.py"
    root = Path(__file__).resolve().parents[1]
    script.write_text(
        f"import sys\nsys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import functions as F\nfrom seriesloom.operators import regression as rg\nfrom seriesloom.session import build_session\n"
        "spark = build_session('ship', 2, 2)\n"
        "df = spark.createDataFrame([('a', float(i), 3.0 * i + 1) for i in range(9)], 'k string, x double, y double')\n"
        "row = rg.fit(df, 'k', ['x'], 'y', F.lit(True)).first()\nassert row.status == 'ok', row\nprint('fitted', row.n)\nspark.stop()\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fitted 9" in done.stdout, done.stderr[-2000:]
