from pyspark.sql import functions as F

from seriesloom.sources import grids, pages

SPANS = """<table><caption>x</caption><thead><tr><th rowspan=2>Era</th><th rowspan="2">Year</th><th colspan=2>Counts</th></tr>
<tr><th>Population</th><th>Share&nbsp;%</th></tr></thead>
<tbody><tr><td rowspan="0">past</td><td>1990</td><td>7,000</td><td>1</td></tr><tr><td>1991</td><td colspan="2">8,000</td></tr><tr></tr></tbody>
<tbody><tr><td>now<td>1992<td>9,000</table>"""
NESTED = """<table><tr><td>menu <table><tr><th>Year</th><th>Population</th></tr><tr><td>2001</td><td>5</td></tr><tr><td>2002</td><td>6</td></tr>
<tr><td>2003</td><td>7<table><tr><td>deep</td></tr></table></td></tr></table> end</td><td>right</td></tr></table>
<script>"<table><tr><td>no</td></tr></table>"</script><table></table><table><tr><td><!-- <td> -->a<br>b</td>"""


def plain(html):
    return [(t.number, t.parent, t.depth, t.numbered()) for t in grids.grids_of(html)]


def test_spans_and_heading_rows():
    assert plain(SPANS) == [(0, None, 0, [
        (-1, ["Era", "Year", "Counts", "Counts"]),
        (0, ["Era", "Year", "Population", "Share %"]),
        (1, ["past", "1990", "7,000", "1"]),
        (2, ["past", "1991", "8,000", "8,000"]),
        (3, ["past"]),
        (4, ["now", "1992", "9,000"]),  # spans end with their section
    ])]


def test_nested_and_broken_markup():
    found = plain(NESTED)
    assert [(n, p, d) for n, p, d, _ in found] == [(0, None, 0), (1, 0, 1), (2, 1, 2), (3, None, 0), (4, None, 0)]
    assert found[0][3] == [(0, ["menu end", "right"])]
    assert found[1][3][-1] == (3, ["2003", "7"]) and found[2][3] == [(0, ["deep"])]
    assert found[3][3] == [] and found[4][3] == [(0, ["a b"])]


def test_a_span_beyond_the_rows_and_wide_cells():
    assert plain("<table><tr><td rowspan=99999>a<td>b<tr><td colspan=x>c</table>")[0][3] == [(0, ["a", "b"]), (1, ["a", "c"])]
    assert len(plain("<table><tr><td colspan=99999>a</table>")[0][3][0][1]) == grids.MOST_COLUMNS
    assert plain("<table><tr><td>a<td rowspan=2>b<tr><td>c<td>d</table>")[0][3][1] == (1, ["c", "b", "d"])


def test_pages_to_chosen_tables(spark):
    docs = [(1, SPANS), (2, NESTED), (3, None), (4, ""), (5, "no tables"), (6, "<ul><li>x")]
    df = spark.createDataFrame(docs, "page_id long, html string").withColumn("cells", F.lit("clash"))
    rows = grids.extract_grids(df, "page_id", "html")
    assert rows.schema.simpleString() == "struct<page_id:bigint,table_id:int,parent_id:int,depth:int,row_no:int,cells:array<string>>"
    assert {r.page_id for r in rows.collect()} == {1, 2}
    tables = pages.year_tables(rows, "page_id")
    spans = pages.table_spans(tables, ["page_id", "table_id"], "year_text", min_years=2)
    chosen = pages.choose_tables_per_group(spans, ["page_id"], ["table_id"]).collect()
    assert sorted((r.page_id, r.role, r.table_id, r.min_year, r.max_year) for r in chosen) == [(1, "history", 0, 1990, 1992), (2, "history", 1, 2001, 2003)]
    assert grids.extract_grids(df.where("false"), "page_id", "html").collect() == []


def test_choice_per_group_equals_the_choice_alone(spark):
    spans = [("a", 1, 5, 1950, 2026), ("a", 2, 5, 1940, 2026), ("a", 3, 5, 2020, 2050), ("b", 1, 5, 1960, 2000), ("b", 2, 5, 1970, 2010), ("c", 7, 3, 1990, 1999)]
    df = spark.createDataFrame(spans, "page string, t int, n_years int, min_year int, max_year int")
    got = sorted(tuple(r) for r in pages.choose_tables_per_group(df, ["page"], ["t"]).collect())
    alone = [(p, *r) for p in "abc" for r in pages.choose_tables(df.where(F.col("page") == p).drop("page"), ["t"]).collect()]
    assert got == sorted(alone) and len(got) == 5
