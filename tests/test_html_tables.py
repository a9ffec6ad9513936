"""Ragged HTML tables keep every row and cell."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

import loomframe.queries.text as queries
from loomframe.sources.readers import first_table, read_html

PAGE = (
    "<table><tr><th>a</th><th>b</th><th>b</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>4</td></tr>"
    "<tr><td colspan=2>total</td><td>9</td></tr><tr><td>5</td><td>6</td><td>7</td><td>8</td></tr><tr><td rowspan='2'>r</td><td>x</td><td>y</td></tr><tr><td>z<td>w</tr></table>"
)
ROWS = [("1", "2", "3", None), ("4", None, None, None), ("total", "total", "9", None), ("5", "6", "7", "8"), ("r", "x", "y", None), ("r", "z", "w", None)]


def test_ragged_rows_are_kept(spark, tmp_path):
    assert first_table(PAGE) == (["a", "b", "b", "Unnamed: 3"], [list(r) for r in ROWS])
    (tmp_path / "p.html").write_text(PAGE)
    df = read_html(spark, str(tmp_path / "p.html")).df
    assert df.columns == ["a", "b", "b.1", "Unnamed: 3"] and [tuple(r) for r in df.collect()] == ROWS


def test_query_counts_ragged_rows(spark, monkeypatch):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>none"), (3, None)], "page_id long, html string")
    monkeypatch.setattr(queries, "_pages", lambda spark, sf: pages)
    assert [(r["page_id"], r["n_rows"]) for r in queries.html_tables(spark, "").collect()] == [(1, 6), (2, 2)]


def test_pages_reach_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    monkeypatch.setattr(queries, "_pages", lambda spark, sf: spark.range(0, 1000, 1, 1).selectExpr("id as page_id", "'' as html"))
    monkeypatch.setattr(queries, "tables_of", F.pandas_udf(lambda html: html.map(lambda _: [[str(len(html))]]), T.ArrayType(T.ArrayType(T.StringType()))))
    try:
        assert max(int(r["header"]) for r in queries.html_tables(spark, "").collect()) <= queries.BATCH_PAGES
    finally:
        spark.conf.set(key, before)
