"""Reshape, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.timeparse import majority_granularity
from ..operators import aggregate, joins, reshape
from ..registry import query, table


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))


def _dated(spark, sf):
    """Orders with their month as text, the form in which time arrives in raw tables."""
    return table(spark, sf, "orders").withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders) WHERE o_orderstatus = 'F' AND o_custkey = 7")
def scan_parquet_filter(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return reshape.filter_equal(rows, {"o_orderstatus": "F", "o_custkey": "7", "unknown": 1})


@query("SELECT o_custkey, CAST(year AS INT) AS year, value FROM (SELECT o_custkey, sum(CASE WHEN year(o_orderdate)=1996 THEN o_totalprice END) AS \"1996\", sum(CASE WHEN year(o_orderdate)=1997 THEN o_totalprice END) AS \"1997\", sum(CASE WHEN year(o_orderdate)=1998 THEN o_totalprice END) AS \"1998\" FROM orders GROUP BY o_custkey) UNPIVOT INCLUDE NULLS (value FOR year IN (\"1996\", \"1997\", \"1998\"))".replace("SELECT o_custkey, CAST(year AS INT) AS year, value", "SELECT o_custkey, CAST(year AS INT) AS year, round(value, 2) AS value"))
def reshape_wide_to_long(spark, sf):
    wide = _orders(spark, sf).groupBy("o_custkey").agg(*[F.sum(F.when(F.col("o_year") == y, F.col("o_totalprice"))).alias(str(y)) for y in (1996, 1997, 1998)])
    return reshape.wide_to_long(wide).withColumn("value", F.round("value", 2))


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS l_returnflag_original, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS meaning FROM lineitem")
def recode_codes(spark, sf):
    rows = reshape.keep_original(table(spark, sf, "lineitem"), "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag_original", reshape.recode(F.col("l_returnflag"), {"A": "accepted", "R": "returned"}).alias("meaning"))


@query("SELECT c_custkey AS entity, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def map_fields(spark, sf):
    return reshape.map_fields(table(spark, sf, "customer"), {"c_custkey": "entity", "c_acctbal": "balance", "c_mktsegment": "segment"})


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def preview_head(spark, sf):
    return reshape.preview(table(spark, sf, "customer"), ["c_custkey"], 20)


JOIN_SQL = "SELECT count(*) AS n_rows, count(o_orderkey) AS n_orders, count(l_linenumber) AS n_lines, round(sum(l_quantity), 2) AS quantity FROM (SELECT o_orderkey AS k, * FROM orders) o {how} JOIN (SELECT l_orderkey AS k, * FROM lineitem WHERE l_orderkey % 3 <> 0) l ON o.k = l.k"


def _join(spark, sf, how):
    left = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey"))
    right = table(spark, sf, "lineitem").filter("l_orderkey % 3 != 0").withColumn("k", F.col("l_orderkey"))
    out = joins.safe_join(left, right, ["k"], how).df
    return out.agg(F.count("*").alias("n_rows"), F.count("o_orderkey").alias("n_orders"), F.count("l_linenumber").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(JOIN_SQL.format(how="INNER"))
def join_inner_1m(spark, sf):
    return _join(spark, sf, "inner")


@query(JOIN_SQL.format(how="LEFT"))
def join_left(spark, sf):
    return _join(spark, sf, "left")


@query(JOIN_SQL.format(how="RIGHT"))
def join_right(spark, sf):
    return _join(spark, sf, "right")


@query(JOIN_SQL.format(how="FULL"))
def join_full(spark, sf):
    return _join(spark, sf, "full_outer")


NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey END"


@query(f"SELECT k, o_totalprice, n FROM (SELECT {NULLED} AS k, o_totalprice FROM orders) JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) USING (k)")
def join_null_keys_excluded(spark, sf):
    left = table(spark, sf, "orders").select(F.expr(NULLED).alias("k"), "o_totalprice")
    right = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.safe_join(left, right, ["k"]).df


REPORT_SQL = f"""
WITH l AS (SELECT k, count(*) AS n FROM (SELECT {NULLED} AS k FROM orders) GROUP BY k), r AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1),
f AS (SELECT l.n AS ln, r.n AS rn, coalesce(l.k, r.k) AS k FROM l FULL JOIN r ON l.k = r.k)
SELECT CASE WHEN sum(CASE WHEN k IS NOT NULL AND ln > 1 THEN 1 ELSE 0 END) > 0 THEN 'm' ELSE '1' END || ':' || CASE WHEN sum(CASE WHEN k IS NOT NULL AND rn > 1 THEN 1 ELSE 0 END) > 0 THEN 'm' ELSE '1' END AS cardinality,
 sum(coalesce(ln, 0))::BIGINT AS row_count_before, sum(CASE WHEN k IS NOT NULL THEN coalesce(ln * rn, 0) ELSE 0 END)::BIGINT AS row_count_after, sum(CASE WHEN k IS NOT NULL THEN coalesce(ln * rn, 0) ELSE 0 END)::BIGINT AS matched,
 count(*) FILTER (WHERE k IS NOT NULL AND ln IS NOT NULL AND rn IS NULL) AS unmatched_left, count(*) FILTER (WHERE k IS NOT NULL AND rn IS NOT NULL AND ln IS NULL) AS unmatched_right,
 sum(CASE WHEN k IS NULL THEN coalesce(ln, 0) + coalesce(rn, 0) ELSE 0 END)::BIGINT AS null_key_rows_dropped, 1.0::DOUBLE AS coverage,
 round(count(*) FILTER (WHERE k IS NOT NULL AND ln IS NOT NULL AND rn IS NOT NULL)::DOUBLE / count(*) FILTER (WHERE k IS NOT NULL AND ln IS NOT NULL), 4) AS left_coverage, false AS explosion
FROM f"""


@query(REPORT_SQL)
def join_report(spark, sf):
    left = table(spark, sf, "orders").select(F.expr(NULLED).alias("k"))
    right = table(spark, sf, "lineitem").filter("l_orderkey % 2 = 1").select(F.col("l_orderkey").alias("k"))
    return joins.join_report(left, right, ["k"])


@query("WITH l AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1) SELECT (SELECT sum(n) FROM l)::BIGINT AS rows_left, (SELECT sum(n) FROM r)::BIGINT AS rows_right, (SELECT sum(n - 1) FROM l)::BIGINT AS dup_left, (SELECT sum(n - 1) FROM r)::BIGINT AS dup_right, (SELECT sum(l.n * r.n) FROM l JOIN r USING (k))::BIGINT AS estimated_rows, 'm:1' AS cardinality")
def join_estimate(spark, sf):
    left, right = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    return joins.key_report(left, right, ["k"]).select("rows_left", "rows_right", "dup_left", "dup_right", "estimated_rows", "cardinality")


@query("SELECT 'JOIN_CARDINALITY_BLOCKED' AS code, 'm:m' AS cardinality")
def join_mm_guard(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity")
    try:
        joins.safe_join(rows, rows, ["k"])
        out = ("NONE", "")
    except EngineError as e:
        out = (e.code, str(e.details["cardinality"]))
    return spark.createDataFrame([out], "code string, cardinality string")


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS sample FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_unmatched(spark, sf):
    left, right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return joins.unmatched_keys(left, right, ["k"], limit=None)


@query("SELECT count(*) AS matched, (SELECT count(DISTINCT o_orderkey) FROM orders) AS keys FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))")
def join_semi_coverage(spark, sf):
    left, right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return joins.key_report(left, right, ["k"]).select(F.col("keys_matched").alias("matched"), F.col("keys_left").alias("keys"))


@query("SELECT c_custkey AS k, n_orders, spent, n_lines FROM customer JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (c_custkey) JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) USING (c_custkey)")
def join_multiway_panel(spark, sf):
    orders = table(spark, sf, "orders")
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    c = lines.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_lines"))
    return joins.join_all([a, b, c], ["k"]).df


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::INT AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def append_union(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return joins.append([a, b])


@query("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def dict_lookup_broadcast(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return joins.lookup(table(spark, sf, "nation"), regions, "n_regionkey").select("n_name", "r_name")


def _yearly(method, expr, weight=False):
    """A query of one method over orders by customer and year, and its SQL."""
    value = "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END"

    def run(spark, sf):
        rows = _dated(spark, sf).select("o_custkey", "period", "o_orderkey", F.expr(value).alias("value"), (F.col("o_orderkey") % 5 + 1).cast("double").alias("w"))
        return aggregate.to_year(rows, "period", {"value": method}, ["o_custkey"], "w" if weight else None, ["o_orderkey"]).withColumn("value", F.round("value", 2))

    run.__name__ = f"agg_year_{method}"
    sql = f"WITH t AS (SELECT o_custkey, year(o_orderdate)::INT AS year, month(o_orderdate) AS m, o_orderkey AS k, {value} AS v, (o_orderkey % 5 + 1)::DOUBLE AS w FROM orders) SELECT o_custkey, year, round({expr}, 2) AS value FROM t GROUP BY o_custkey, year"
    return query(sql)(run)


agg_year_mean = _yearly("mean", "avg(v)")
agg_year_sum = _yearly("sum", "coalesce(sum(v), 0.0)")
agg_year_min = _yearly("min", "min(v)")
agg_year_max = _yearly("max", "max(v)")
agg_year_median = _yearly("median", "median(v)")
agg_year_first = _yearly("first", "(list(v ORDER BY m, k) FILTER (WHERE v IS NOT NULL))[1]")
agg_year_last = _yearly("last", "(list(v ORDER BY m DESC, k DESC) FILTER (WHERE v IS NOT NULL))[1]")
agg_year_none = _yearly("none", "(list(v ORDER BY m, k) FILTER (WHERE v IS NOT NULL))[1]")
agg_year_weighted_mean = _yearly("weighted_mean", "coalesce(sum(v * w), 0) / sum(w)", weight=True)


@query("SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def agg_dup_counts(spark, sf):
    return aggregate.duplicate_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(DISTINCT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END) AS vals FROM events")
def agg_nunique(spark, sf):
    return table(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count_distinct(F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END")).alias("vals"))


@query("WITH x AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INT AS place FROM x) WHERE place <= 5")
def agg_topk_values(spark, sf):
    return aggregate.top_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("WITH s AS (SELECT 'l_quantity' AS column_name, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) SELECT column_name, min(v)::DOUBLE AS v_min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v)::DOUBLE AS v_max, round(avg(v), 6) AS mean FROM s GROUP BY 1")
def agg_quantiles(spark, sf):
    return aggregate.quantiles(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"]).withColumn("mean", F.round("mean", 6))


@query("SELECT 'value' AS column_name, count(*) FILTER (WHERE event_id % 7 = 0) AS n_null, round(count(*) FILTER (WHERE event_id % 7 = 0)::DOUBLE / count(*), 4) AS null_ratio FROM events UNION ALL SELECT 'user_id', 0, 0.0 FROM (SELECT 1)")
def agg_null_ratio(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END").alias("value"))
    return aggregate.null_ratios(rows, ["value", "user_id"])


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_status_hist(spark, sf):
    return aggregate.status_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT 'month' AS frequency")
def freq_majority(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, F.year("o_orderdate").cast("string")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("period"))
    return majority_granularity(rows, "period")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::INT + grouping(l_linestatus)::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag").cast("int") + F.grouping("l_linestatus").cast("int")).alias("level"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders) WHERE place <= 3")
def ext_rank_window(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("place")).filter("place <= 3")


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def ext_intersect(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0")
def ext_except(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select("o_custkey"))
