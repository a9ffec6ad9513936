"""Structured Streaming over the events, each run to the end of what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, table
from ..streaming import pacing, state, stateful
from .sources import _scratch


def _stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe(spark, sf):
    """Keys that weren't seen before; the state holds each key once."""
    folder = _scratch(spark)
    state.run_available(_stream(spark, sf).select("user_id").dropDuplicates(["user_id"]), f"{folder}/out", f"{folder}/log")
    return spark.read.schema("user_id long").parquet(f"{folder}/out")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_incremental_counts(spark, sf):
    """Counts kept by batches: each adds its partial counts, the reader sums them."""
    folder = _scratch(spark)

    def step(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    state.each_batch(_stream(spark, sf).select("event_type"), step, f"{folder}/log")
    return spark.read.schema("event_type string, n long, batch int").parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf):
    """Daily windows of event time, complete at the end of the input."""
    folder = _scratch(spark)
    rows = _stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = rows.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))

    def step(batch, number):
        batch.select(F.to_date("window.start").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    state.each_batch(counted, step, f"{folder}/log", "update")
    kept = spark.read.schema("day date, event_type string, n long, batch int").parquet(f"{folder}/out")
    return state.latest(kept, ["day", "event_type"], ["batch"]).select("day", "event_type", "n")


@query("SELECT event_id, user_id, event_type, row_number() OVER w = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER w AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def stream_changes(spark, sf):
    """Whether each event's type differs from the user's last one, from state kept for each user."""
    folder = _scratch(spark)
    with stateful.state_store(spark):
        state.run_available(stateful.changes(_stream(spark, sf).select("event_id", "user_id", "event_type"), ["user_id"], ["event_id"], "event_type"), f"{folder}/out", f"{folder}/log")
    return spark.read.schema("event_id long, user_id long, event_type string, changed boolean").parquet(f"{folder}/out")


@query("""WITH e AS (SELECT user_id, event_id, value > 50 AS s, count(*) FILTER (WHERE value > 50) OVER w AS won, count(*) FILTER (WHERE NOT value > 50) OVER w AS lost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT *, CASE WHEN s AND won >= 2 THEN 'VERIFIED' WHEN NOT s AND lost >= 2 THEN 'STALE' END AS told FROM e)
SELECT user_id, count(*) FILTER (WHERE s) AS successes, count(*) FILTER (WHERE NOT s) AS failures, coalesce(arg_max(told, event_id) FILTER (WHERE told IS NOT NULL), 'UNVERIFIED') AS status FROM t GROUP BY user_id""")
def stream_experience(spark, sf):
    """What each user's events say of success, from state kept for each user."""
    folder = _scratch(spark)
    rows = _stream(spark, sf).select("user_id", "event_id", (F.col("value") > 50).alias("ok"))
    with stateful.state_store(spark):
        state.run_available(stateful.experience(rows, "user_id", ["event_id"], "ok"), f"{folder}/out", f"{folder}/log")
    kept = spark.read.schema("user_id long, successes long, failures long, status string").parquet(f"{folder}/out")
    return state.latest(kept, ["user_id"], ["successes", "failures"])


@query("""WITH r AS (SELECT event_id, event_type, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY event_type ORDER BY epoch(ts), event_id) AS k FROM events)
SELECT event_id, event_type, k * 900.0 + max(t - k * 900.0) OVER (PARTITION BY event_type ORDER BY k) AS start FROM r""")
def domain_pacing(spark, sf):
    """When each event's request may go, with a quarter of an hour between requests of a type."""
    rows = table(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    rows = rows.withColumn("t", F.col("t") / 1e6)
    return pacing.paced(rows, "event_type", "t", F.lit(900.0), F.floor(F.col("t") / 86400), ["event_id"]).select("event_id", "event_type", "start")
