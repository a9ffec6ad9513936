"""Incremental collection and state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import crawl, state


def _snapshots(spark, sf):
    """Two snapshots of the pages; every fifth changed between them, every seventh is new in the second."""
    pages = table(spark, sf, "pages").select("page_id", F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("url"), F.md5("html").alias("text_hash"))
    now = pages.withColumn("text_hash", F.when(F.col("page_id") % 5 == 0, F.concat("text_hash", F.lit("x"))).otherwise(F.col("text_hash")))
    return pages.filter("page_id % 7 != 0"), now


@query("SELECT page_id, page_id % 7 <> 0 AND page_id % 5 <> 0 AS skip FROM pages")
def incremental_skip(spark, sf):
    before, now = _snapshots(spark, sf)
    return state.with_state(now, before).select("page_id", "skip")


@query("SELECT page_id, run, CASE run WHEN 1 THEN true ELSE page_id % 7 = 0 OR page_id % 5 = 0 END AS changed FROM (SELECT page_id, 1 AS run FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT page_id, 2 FROM pages)")
def change_detect(spark, sf):
    before, now = _snapshots(spark, sf)
    both = before.withColumn("run", F.lit(1)).union(now.withColumn("run", F.lit(2)))
    return state.changes(both, ["url"], ["run"], "text_hash").select("page_id", "run", "changed")


CRAWL_SQL = """
WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation), l AS (SELECT k, (k * 2 + 1) % 25 AS t FROM n UNION ALL SELECT k, (k * 3 + 2) % 25 FROM n),
w(k, depth) AS (SELECT 0, 0 UNION SELECT l.t, w.depth + 1 FROM w JOIN l ON l.k = w.k WHERE w.depth < 3 AND l.t % 11 <> 5)
SELECT 'http://h.example/' || k AS url, min(depth)::INT AS depth FROM w GROUP BY k"""


@query(CRAWL_SQL)
def frontier_bfs(spark, sf):
    if not spark.sparkContext.getCheckpointDir():
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="loomframe-"))
    k = F.col("n_nationkey")
    page = lambda c: F.concat(F.lit("http://h.example/"), c.cast("string"))
    links = table(spark, sf, "nation").select(page(k).alias("url"), F.explode(F.array(page((k * 2 + 1) % 25), page((k * 3 + 2) % 25))).alias("link"))
    banned = [f"/{i}" for i in range(25) if i % 11 == 5]
    kept = links.filter(~F.col("link").isin(*[f"http://h.example{b}" for b in banned]))
    return crawl.crawl(kept, crawl.CrawlPlan(("http://h.example/0",), ("h.example",), 1000, 3))


EXPERIENCE_SQL = """
WITH e AS (SELECT user_id, ts, event_id, event_type <> 'error' AND event_id % 4 <> 0 AS s FROM events),
r AS (SELECT *, count(*) FILTER (WHERE s) OVER w AS won, count(*) FILTER (WHERE NOT s) OVER w AS lost FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, CASE WHEN s AND won >= 2 THEN 'VERIFIED' WHEN NOT s AND lost >= 2 THEN 'STALE' END AS st FROM r)
SELECT user_id, count(*) FILTER (WHERE s) AS successes, count(*) FILTER (WHERE NOT s) AS failures, coalesce((list(st ORDER BY ts DESC, event_id DESC) FILTER (WHERE st IS NOT NULL))[1], 'UNVERIFIED') AS status FROM t GROUP BY user_id"""


@query(EXPERIENCE_SQL)
def experience_status(spark, sf):
    rows = table(spark, sf, "events").withColumn("s", (F.col("event_type") != "error") & (F.col("event_id") % 4 != 0))
    return state.experience(rows, "user_id", ["ts", "event_id"], "s")


@query("SELECT event_id, used <= 20000 AS allowed FROM (SELECT event_id, sum(event_id % 97) OVER (PARTITION BY ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)")
def quota_running_sum(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("day"), (F.col("event_id") % 97).alias("size"))
    return state.within_quota(rows, "day", ["ts", "event_id"], "size", 20000, F.date_trunc("hour", "ts")).select("event_id", "allowed")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW')")
def catalog_unfinished(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus").isin("O", "P") & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def catalog_latest(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return state.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_finished FROM orders GROUP BY 1")
def catalog_task_counts(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def catalog_recent(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")
