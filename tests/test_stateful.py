"""Keyed streams over stops and restarts, pacing and fan-out against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomframe.plans import fanout
from loomframe.streaming import pacing, state, stateful


def batches(spark, tmp_path, rows, schema, n=3):
    """A folder that gets the rows in ``n`` files, one at a time; yields before each run."""
    size = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        yield spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_streams_that_stop_and_start_are_the_batch_forms(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"u{rng.randrange(6)}", rng.choice(["a", "b", None]), rng.random() < 0.6) for i in range(90)]
    schema = "i long, url string, hash string, ok boolean"
    with stateful.state_store(spark):
        for stream in batches(spark, tmp_path, rows, schema):  # each round is a query of its own that goes on from the checkpoint
            state.run_available(stateful.changes(stream, ["url"], ["i"], "hash"), str(tmp_path / "c"), str(tmp_path / "clog"))
            state.run_available(stateful.experience(stream, "url", ["i"], "ok"), str(tmp_path / "e"), str(tmp_path / "elog"))
    whole = spark.createDataFrame(rows, schema)
    want = state.changes(whole, ["url"], ["i"], "hash")
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "c")).select(want.columns).collect())) == sorted(map(str, want.collect()))
    told = state.latest(spark.read.parquet(str(tmp_path / "e")), ["url"], ["successes", "failures"])
    want = state.experience(whole, "url", ["i"], "ok")
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.select(told.columns).collect()))


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    schema = "i long, url string, hash string"
    with stateful.state_store(spark):
        for k, stream in enumerate(batches(spark, tmp_path, [(0, "u", "a"), (1, "u", "a")], schema, 2)):
            if k:
                time.sleep(2.5)
            state.run_available(stateful.changes(stream, ["url"], ["i"], "hash", ttl_ms=1000), str(tmp_path / "c"), str(tmp_path / "log"))
    assert [r["changed"] for r in spark.read.parquet(str(tmp_path / "c")).orderBy("i").collect()] == [True, True]


@pytest.mark.parametrize("width", [7, 100_000])
def test_pacing_is_that_of_a_loop(spark, width):
    rng = random.Random(width)
    rows = [(i, "busy" if rng.random() < 0.8 else rng.choice(["x", "y", None]), float(rng.randrange(1200))) for i in range(600)]
    got = {r["i"]: r["start"] for r in pacing.paced(spark.createDataFrame(rows, "i int, d string, t double"), "d", "t", F.when(F.col("d") == "busy", 1.5).otherwise(40.0), F.floor(F.col("t") / width), ["i"]).collect()}
    last: dict = {}
    for i, d, t in sorted(rows, key=lambda r: (r[2], r[0])):
        last[d] = max(t, last[d] + (1.5 if d == "busy" else 40.0)) if d in last else t
        assert got[i] == pytest.approx(last[d])
    assert len(got) == 600


def test_slow_and_failing_sources_leave_the_others(spark):
    def _sleep(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def slow(s):
        return s.range(1, numPartitions=1).mapInPandas(_sleep, "id long")

    began = time.monotonic()
    found = fanout.search_all(spark, {"a": lambda s: s.range(3), "slow": slow, "bad": lambda s: s.table("no_such_table"), "worse": lambda s: 1 / 0, "b": lambda s: s.range(2)}, most=3, seconds=15)
    tasks = {r["provider"]: r for r in found.tasks.collect()}
    print(tasks)
    assert {n: r["status"] for n, r in tasks.items()} == {"a": "success", "slow": "timeout", "bad": "failed", "worse": "failed", "b": "success"}
    assert time.monotonic() - began < 50
    assert "no_such_table" in tasks["bad"]["error"] and tasks["a"]["n_rows"] == 3
    assert sorted(map(tuple, found.rows.select("provider", "id").collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
