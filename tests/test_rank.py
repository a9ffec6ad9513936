"""Quantiles by refined histograms, frequent values with proof, and fills carried over ranges, against plain forms."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import aggregate, missing, rank


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(2)
    kinds = [lambda: rng.gauss(0, 1), lambda: rng.choice([-5.0, 0.0, 7.25]), lambda: 10 ** rng.uniform(-200, 200) * rng.choice([1, -1]), lambda: rng.randrange(10**12) / 7]
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.choice(kinds)()) for _ in range(6000)] + [("one", 4.0), ("two", 4.0), ("two", 9.0), ("ends", float("inf")), ("ends", float("-inf")), ("ends", 1.0), ("none", None)]
    return rows, spark.createDataFrame(rows, "g string, v double")


def test_quantiles_are_numpys(spark, numbers):
    rows, df = numbers
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: r["q"] for r in rank.quantiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {g for g, v in rows if v is not None}
    for g, q in got.items():
        mine = sorted(v for h, v in rows if h == g and v is not None)
        for p, x in zip(shares, q, strict=True):
            at = p * (len(mine) - 1)
            low, high = mine[int(np.floor(at))], mine[int(np.ceil(at))]
            if g == "ends" and low != high:  # between infinities there is no value
                continue
            assert x == low if low == high else x == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12)
    whole = rank.quantiles(df.filter("g is null or g <> 'ends'"), [], "v", [0.5]).first()["q"][0]
    assert whole == pytest.approx(np.median([v for g, v in rows if g != "ends" and v is not None]), rel=1e-12)


def test_weights_count_as_repeats(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4)], "v double, n long")
    assert rank.quantiles(df, [], "v", [0.25, 0.5, 0.9], weight="n").first()["q"] == np.quantile([1, 1, 1, 2, 10, 10, 10, 10], [0.25, 0.5, 0.9]).tolist()
    assert rank.quantiles(df.filter("v > 99"), ["n"], "v", [0.5]).count() == 0


def test_no_task_holds_all_values(spark, numbers):
    _, df = numbers
    plan = rank.quantiles(df, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median" not in plan


@pytest.mark.parametrize("followed", [4, 1000])
def test_top_values(spark, followed):
    rng = random.Random(5)
    rows = [(rng.choice("aabbbcd"), str(min(int(rng.expovariate(0.05)), 400)), f"u{i}", None) for i in range(3000)]
    rows += [("e", "0", None, None)] * 9
    df = spark.createDataFrame(rows, "few string, many string, unique string, nothing string")
    got = sorted((r.column_name, r.place, r.value, r.n) for r in aggregate.top_values(df, df.columns, 5, followed).collect())
    want = []
    for c, name in enumerate(df.columns):
        counts = Counter(r[c] for r in rows if r[c] is not None)
        want += [(name, k + 1, v, n) for k, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:5])]
    assert got == sorted(want)


@pytest.mark.parametrize("method", ["ffill", "bfill", "linear"])
@pytest.mark.parametrize("parts", [1, 3, 9])
def test_fills_without_a_group_are_those_of_one_window(spark, method, parts):
    rng = random.Random(parts)
    rows = [(i, None if rng.random() < 0.7 or 20 < i < 90 else rng.randrange(100), None if rng.random() < 0.9 else f"t{i}") for i in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, v int, t string").repartition(3)
    columns = ["v", "t"] if method != "linear" else ["v"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = missing.fill(df, columns, method, order=["i"])
        got = sorted(map(tuple, out.collect()))
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = missing.fill(df.withColumn("g", F.lit(1)), columns, method, ["g"], ["i"]).drop("g")
    assert got == sorted(map(tuple, want.select(out.columns).collect()))
    assert sum(r[-1] for r in got) > 20


@pytest.mark.parametrize("method", ["bfill", "linear"])
@pytest.mark.parametrize("group", [[], ["g"]])
def test_fills_read_no_frame_to_its_end_for_each_row(spark, method, group):
    """A frame that ends with its partition takes the square of its rows."""
    rows = [(0, i // 2, i, None if i % 5 else i) for i in range(100)] + [(1, None, 0, None), (1, 3, 1, 7), (1, None, 2, None)]
    df = spark.createDataFrame(rows, "g int, t int, i int, v int")
    order = ["g", "t", "i"] if not group else ["t", "i"]
    out = missing.fill(df, ["v"], method, group, order)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {(r["g"], r["i"]): r["v"] for r in out.collect()}
    assert [got[0, i] for i in (0, 1, 4, 95)] == ([0, 5, 5, 95] if method == "bfill" else [0, 1, 4, 95])
    across = {"bfill": (7, 7), "linear": (95 + 5 * (7 - 95) / 7, 95 + 6 * (7 - 95) / 7)}
    within = {"bfill": (7, 7), "linear": (None, None)}
    assert (got[1, 0], got[1, 2]) == pytest.approx(across[method] if not group else within[method])
