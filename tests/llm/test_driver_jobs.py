"""What the driver plans and keeps: jobs and plans don't grow with the number of partitions or levels."""

import pytest
from pyspark.sql import functions as F

from loomframe.llm import mixing, ngram_join, toxicity
from loomframe.llm.base import durable

PARTITIONS = 40
KEYS = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def jobs(spark):
    """Counts the jobs of a call where every shuffle has many partitions."""
    before = {k: spark.conf.get(k, None) for k in KEYS}
    for k, v in KEYS.items():
        spark.conf.set(k, v)

    def count(call):
        group = f"jobs of {call}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            out = call()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    yield count
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_frequent_shingles_reach_the_driver_in_few_jobs(spark, jobs):
    index = durable(spark.range(ngram_join.HOT + 2).select(F.array((F.col("id") % 2) * 0 + 7, F.col("id") + 100, F.when(F.col("id") < ngram_join.HOT, -5).otherwise(-6).cast("long")).alias("prefix")))
    hot, n = jobs(lambda: ngram_join._hot_shingles(index))
    assert hot.tolist() == [-5, 7] and n < PARTITIONS
    assert ngram_join._hot_shingles(index.limit(1)).tolist() == []


def test_labelled_rows_reach_the_driver_in_few_jobs(spark, jobs):
    docs = durable(spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.when(F.col("id") % 2 == 0, "vile ").otherwise("kind "), F.sha1(F.col("id").cast("string"))).alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("toxic"))
    model, n = jobs(lambda: toxicity.train(docs, labels))
    assert "vile" in model.weights and "kind" not in model.weights and n < PARTITIONS


def test_plan_of_thresholds_holds_one_level(spark):
    narrow = durable(mixing.sized(spark.createDataFrame([(i, "a b " * (i % 9), "xyz"[i % 3]) for i in range(90)], "doc_id long, text string, source string")))
    plan = mixing.thresholds(narrow)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1
