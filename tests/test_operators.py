"""Panel operators on literal tables: joins, fills, formulas, time, entities, states and crawls."""

import pytest
from pyspark.sql import functions as F

from loomframe.errors import EngineError
from loomframe.functions import entities, formula
from loomframe.operators import joins, missing
from loomframe.streaming import crawl, state


def test_join_report(spark):
    left = spark.createDataFrame([("USA", 2015, 1.0), ("CHN", 2015, 2.0), ("DEU", 2015, 3.0)], "iso3 string, year int, gdp double")
    right = spark.createDataFrame([("USA", 2015, 5.0), ("CHN", 2015, 4.0)], "iso3 string, year int, unemp double")
    r = joins.join_report(left, right, ["iso3", "year"]).first()
    assert (r["cardinality"], r["matched"]) == ("1:1", 2) and r["left_coverage"] == pytest.approx(2 / 3, abs=1e-4)
    assert joins.safe_join(left, right, ["iso3", "year"]).df.count() == 2


def test_many_to_many_is_refused(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([("a", 3), ("a", 4)], "k string, y int")
    with pytest.raises(EngineError) as e:
        joins.safe_join(left, right, ["k"])
    assert e.value.code == "JOIN_CARDINALITY_BLOCKED"


def test_linear_fill(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 4.0)], "year int, v double")
    out = missing.fill(df, ["v"], "linear", [], ["year"])
    assert [r["v"] for r in out.orderBy("year").collect()] == [1.0, 2.0, 3.0, 4.0]
    assert [r["__imputed_v"] for r in out.orderBy("year").collect()] == [False, True, True, False]


def test_formula(spark):
    df = spark.createDataFrame([(100.0, 10.0), (200.0, 0.0)], "gdp double, population double")
    out = formula.derive(df, "gdp / population", "r", ["gdp", "population"])
    assert sorted((r["r"] for r in out.collect()), key=lambda x: (x is None, x)) == [10.0, None]
    for bad in ("gdp / income", "__import__('os')", "gdp.x", "gdp if gdp else 1"):
        with pytest.raises(EngineError):
            formula.derive(df, bad, "r", ["gdp", "population"])


def test_countries(spark):
    labels = [("United States", "USA"), ("USA", "USA"), ("US", "USA"), ("840", "USA"), ("CHN", "CHN"), ("China", "CHN"), ("Atlantis", None)]
    df = spark.createDataFrame(labels, "raw string, want string")
    assert all(r["iso3"] == r["want"] for r in entities.resolve_countries(df, "raw", fuzzy=False).collect())


def test_unchanged_pages_are_skipped(spark):
    known = spark.createDataFrame([("u", "E1", "aaa")], "url string, etag string, text_hash string")
    now = spark.createDataFrame([("u", "E1", None), ("u", "E2", "bbb"), ("u", "E3", "aaa"), ("w", "E1", "aaa"), (None, "E1", "aaa")], "url string, etag string, text_hash string")
    got = {(r["url"], r["etag"]): r["skip"] for r in state.with_state(now, known).collect()}
    assert got == {("u", "E1"): True, ("u", "E2"): False, ("u", "E3"): True, ("w", "E1"): False, (None, "E1"): False}


def test_changes_and_latest(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b")], "url string, t int, h string")
    assert [r["changed"] for r in state.changes(df, ["url"], ["t"], "h").orderBy("t").collect()] == [True, False, True]
    assert state.latest(df, ["url"], ["t"]).first()["h"] == "b"
    assert {r["url"] for r in state.unseen(df.select("url"), df.select("url").limit(0), "url").collect()} == {"u"}


def test_experience(spark):
    events = [("a", 1, True), ("a", 2, True), ("b", 1, True), ("b", 2, False), ("b", 3, False), ("c", 1, True)]
    got = {r["k"]: r["status"] for r in state.experience(spark.createDataFrame(events, "k string, t int, s boolean"), "k", ["t"], "s").collect()}
    assert got == {"a": "VERIFIED", "b": "STALE", "c": "UNVERIFIED"}


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    source, out, log = (f"{tmp_path}/{n}" for n in ("in", "out", "log"))
    for ids in ([1, 2, 2], [2, 3]):
        spark.createDataFrame([(i,) for i in ids], "k long").coalesce(1).write.mode("append").parquet(source)
        state.run_available(spark.readStream.schema("k long").parquet(source).dropDuplicates(["k"]), out, log)
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_crawl(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    pairs = [("/", "/a"), ("/", "/b"), ("/a", "/c"), ("/c", "/d"), ("/d", "/e"), ("/a", "/private/x"), ("/b", "/")]
    links = spark.createDataFrame([(f"http://h.org{a}", f"http://h.org{b}") for a, b in pairs] + [("http://h.org/", "http://other.net/")], "url string, link string")
    plan = crawl.CrawlPlan(("http://h.org/",), ("h.org",), 25, 3)
    rules = crawl.robots_rules("User-agent: *\nDisallow: /private # no\n\nUser-agent: other\nDisallow: /")
    got = {r["url"].removeprefix("http://h.org"): r["depth"] for r in crawl.crawl(links, plan, rules).collect()}
    assert got == {"/": 0, "/a": 1, "/b": 1, "/c": 2, "/d": 3}
    assert crawl.crawl(links, crawl.CrawlPlan(("http://h.org/",), ("h.org",), 2, 3)).count() == 2
    for bad in ({"seeds": ()}, {"seeds": ("ftp://x",)}, {"seeds": ("http://x",), "max_pages": 0}):
        with pytest.raises(EngineError):
            crawl.CrawlPlan(**bad)


def test_quota(spark):
    df = spark.createDataFrame([("d", 1, 5), ("d", 2, 5), ("d", 3, 1), ("e", 1, 11)], "day string, t int, size int")
    got = state.within_quota(df, "day", ["t"], "size", 10).orderBy("day", "t").select(F.col("allowed")).collect()
    assert [r["allowed"] for r in got] == [True, True, False, False]
