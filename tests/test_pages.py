"""Functions over pages against Python's own, and the queries that SQL doesn't cover."""

import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from loomframe.functions import entities, text, timeparse
from loomframe.operators import validate
from loomframe.queries import text as page_queries

SF = "/root/testdata/sf0.001"
BASES = ["https://h.org", "https://h.org/", "http://h.org:8080/a/b/c.html?x=1#y", "https://h.org/a/b/"]
HREFS = ["x", "x/y", "/x", "//g.org/z", "?q", "../x", "../../x", "./x", "a/./b", "a/../b", "http://g.org/p", "../../../../x", "a/b/../../c"]


def test_links_are_joined_as_python_joins_them(spark):
    rows = [(b, h) for b in BASES for h in HREFS]
    df = spark.createDataFrame(rows, "base string, href string").select("base", "href", text.absolute(F.col("base"), F.col("href")).alias("got"))
    wrong = [(r["base"], r["href"], r["got"], urljoin(r["base"], r["href"])) for r in df.collect() if r["got"] != urljoin(r["base"], r["href"])]
    assert not wrong


def test_crawl_addresses(spark):
    cases = {"HTTPS://H.org:443/a/?utm_source=x&id=5&ref=a#top": "HTTPS://h.org/a?id=5", "http://h.org": "http://h.org/", "http://h.org:81/b?k": "http://h.org:81/b?k="}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", text.crawl_url(F.col("u")).alias("got"))
    assert {r["u"]: r["got"] for r in df.collect()} == cases
    got = page_queries.url_canonicalize_crawl(spark, SF).collect()
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:  # what follows the page's own # is no query
        assert r["url"] and "utm" not in r["url"] and "#" not in r["url"] and r["url"].endswith("id=5") == ("#" not in urls[r["page_id"]])


def test_markdown_of_pages(spark):
    html = '<html><head><title>T</title><style>p{}</style></head><body>menu<main><h2>Head</h2><p>One <a href="/x">two</a>&amp;&lt;3</p><script>bad()</script><ul><li>a</li><li>b</li></ul></main></body></html>'
    got = spark.createDataFrame([(html,)], "h string").select(text.to_markdown(F.col("h"))).first()[0]
    assert got == "## Head\nOne [two](/x)&<3\n a\nb" and "menu" not in got
    assert page_queries.html_markdown(spark, SF).filter("text rlike '<script'").count() == 0


def test_linked_data_blocks(spark):
    block = {"@type": "Dataset", "name": "n"}
    html = f'<script type="application/ld+json">{json.dumps(block)}</script><script>var x</script><script type=\'application/ld+json\'>not json</script>'
    got = spark.createDataFrame([(html,)], "h string").select(F.explode(text.jsonld_blocks(F.col("h"))).alias("b")).collect()
    assert [r["b"] for r in got] == [json.dumps(block), "not json"]


@pytest.mark.parametrize(("values", "kind", "want"), [(["USA", "China", "nowhere"], "country", True), (["USA", "x", "y"], "country", False), (["河北省", "北京"], "province", True)])
def test_columns_tell_what_they_hold(spark, values, kind, want):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert entities.holds(df, "v", kind) == want
    assert entities.holds(df.withColumnRenamed("v", "country"), "country", "country")


def test_fuzzy_countries_and_names_of_their_time(spark):
    df = spark.createDataFrame([("Germny",), ("Untied States of America",), ("World",), ("South Asia",)], "v string")
    assert {r["v"]: r["iso3"] for r in entities.resolve_countries(df, "v").collect()} == {"Germny": "DEU", "Untied States of America": None, "World": None, "South Asia": None}
    old = spark.createDataFrame([("襄樊市", 2000), ("襄樊市", 2015)], "v string, y int")
    assert {r["y"]: r["c"] for r in entities.resolve_regions(old, "v", "prefecture", F.col("y"), out="c").collect()} == {2000: "420600", 2015: None}


def test_checks_of_joins_and_imputed_cells(spark):
    report = spark.createDataFrame([(0.5, 3, 1)], "left_coverage double, unmatched_left long, unmatched_right long")
    assert {r["code"]: r["affected"] for r in validate.check_join(report).collect()} == {"JOIN_COVERAGE_LOW": 4, "UNMATCHED_ENTITIES": 4}
    masked = spark.createDataFrame([(1, True), (2, False)], "x int, __imputed_x boolean")
    assert [tuple(r) for r in validate.check_imputed(masked).collect()] == [("IMPUTATION_PRESENT", "INFO", "x", 1)]


def test_majority_and_time_columns(spark):
    df = spark.createDataFrame([("2020-01", "a"), ("2020-02", "b"), ("2021", "c")], "when string, name string")
    assert timeparse.majority_granularity(df, "when").first()[0] == "month" and timeparse.find_time_column(df) == "when"
    rows = timeparse.with_time(df, "when", "t").orderBy("when").collect()
    assert [(r["t"]["granularity"], r["t"]["year"], r["t"]["month"]) for r in rows] == [("month", 2020, 1), ("month", 2020, 2), ("year", 2021, None)]


def test_links_of_any_depth_are_those_of_the_library(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    from loomframe.functions import text

    bases = ["https://h.org/a/b/c/d/e/f/g/h.html", "https://h.org", "https://h.org/x/?q=../1"]
    hrefs = ["../../../../../../x", "../" * 12 + "y/../z", "./a/./b/..", "../..", "..", ".", "k/../../../m?p=/../n#/../o", "/p/./q/../../r/", "...", "a..b/c", "/../up"]
    rows = [(b, h) for b in bases for h in hrefs]
    got = {(r["b"], r["h"]): r["u"] for r in spark.createDataFrame(rows, "b string, h string").withColumn("u", text.absolute(F.col("b"), F.col("h"))).collect()}
    assert got == {(b, h): urljoin(b, h) for b, h in rows}


def test_main_part_is_a_named_division_where_there_is_no_main(spark):
    from pyspark.sql import functions as F

    from loomframe.functions import text

    html = "<html><title>T</title><body><nav>menu</nav><div class=\"page-content x\"><p>one</p><div>two</div></div> <footer>foot</footer></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(text.page_markdown(F.col("h"))).first()[0]
    assert row.startswith("# T\n\n") and "one" in row and "two" in row and "menu" not in row and "foot" not in row
