"""Exact quantiles of any number of groups by refining histograms of values; memory is buckets, not values.

A first pass counts values by sign and binary exponent.  The bucket that holds a wanted rank is
known from running counts; each further pass counts only the values in such buckets, in SPLIT
equal steps between their least and largest value, until the rank meets a bucket's end or a bucket
of equal values.  Doubles have 52 bits below their exponent, so at most six passes are made, and
data with few digits need two or three.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

SPLIT = 4096
#: Fixed: beyond all sums of exponent and offset that doubles have.
FAR = 5000


def magnitude(v: Column) -> Column:
    """A whole number that grows with ``v``: sign and binary exponent, ends for infinities and NaN."""
    size = (F.floor(F.log2(F.abs(v))) + 1101).cast("int")
    return F.when(F.isnan(v), FAR + 1).when(v == float("inf"), FAR).when(v == float("-inf"), -FAR).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which nulls of the keys are equal; the left side's keys stay."""
    named = b.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in b.columns])
    on = None
    for k in keys:
        here = a[k].eqNullSafe(named[f"_k_{k}"])
        on = here if on is None else on & here
    return a.join(named, on, how).drop(*[f"_k_{k}" for k in keys])


def _found(counts: DataFrame, keys: list[str], step: str, ranks: Column) -> DataFrame:
    """Buckets (keys, step, n, lo, hi) to (keys, rank, off, n, lo, hi): where each wanted rank lies; ``ranks`` count from each key's first value."""
    up = Window.partitionBy(*keys).orderBy(step)
    at = counts.withColumn("_upto", F.sum("_n").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    mine = F.filter(ranks, lambda r: (r["_off"] >= F.col("_upto") - F.col("_n")) & (r["_off"] < F.col("_upto")))
    return at.withColumn("_r", F.explode(mine)).select(*keys, F.col("_r._rank").alias("_rank"), (F.col("_r._off") - F.col("_upto") + F.col("_n")).alias("_off"), "_n", "_lo", "_hi")


def _settled() -> Column:
    return (F.col("_lo") == F.col("_hi")) | (F.col("_off") == 0) | (F.col("_off") == F.col("_n") - 1)


def _refined(inside: DataFrame, keys: list[str]) -> DataFrame:
    """The values within open buckets counted in SPLIT steps between each bucket's ends."""
    step = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLIT), F.lit(SPLIT - 1))
    return inside.groupBy(*keys, F.col("_lo").alias("_least"), step.alias("_s")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("_ranks").alias("_ranks"))


def _few(data: DataFrame, first: DataFrame, keys: list[str], part: list[str], shares: Sequence[float], name: str) -> DataFrame:
    """The quantiles of few groups: the open ranks, a row for each group and rank, go by way of the driver."""
    spark = data.sparkSession
    fields = [data.schema[k] for k in part]
    wanted = T.StructType([*fields, *T._parse_datatype_string("_total long, _lo double, _hi double, _ranks array<struct<_rank: long, _off: long>>").fields])
    counts, cuts, values, totals = first, [*part, "_total"], {}, {}
    while True:
        open_: dict[tuple, list] = {}
        for r in _found(counts, cuts, "_s", F.col("_ranks")).collect():
            key = tuple(r[k] for k in part)
            totals[key] = r["_total"]
            if r["_lo"] == r["_hi"] or r["_off"] in (0, r["_n"] - 1):
                values[key, r["_rank"]] = r["_lo"] if r["_off"] == 0 else r["_hi"]
            else:
                open_.setdefault((*key, r["_total"], r["_lo"], r["_hi"]), []).append((r["_rank"], r["_off"]))
        if not open_:
            break
        left = spark.createDataFrame([(*k, v) for k, v in open_.items()], wanted)
        counts, cuts = _refined(same(data, F.broadcast(left), part).filter(F.col("_v").between(F.col("_lo"), F.col("_hi"))), [*part, "_total"]), [*part, "_total", "_least"]
    rows = []
    for key, total in totals.items():
        q = []
        for p in shares:
            at = p * (total - 1)
            low, high = values[key, math.floor(at)], values[key, math.ceil(at)]
            q.append(low if low == high else low * (math.ceil(at) - at) + high * (at - math.floor(at)))
        rows.append((*key, q))
    out = T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    return spark.createDataFrame(rows, out).select(*keys, name)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], weight: str | None = None, name: str = "q", few: bool = False) -> DataFrame:
    """(keys, q): the interpolated quantiles of every group's values, nulls left out; ``weight`` is how often a row counts.

    ``few`` says that groups are few, such as columns: the open ranks then go by way of the driver, else by a table.
    """
    keys, one = list(keys), F.lit(1).cast("long")
    part = keys or ["_all"]
    data = rows if keys else rows.withColumn("_all", F.lit(0))
    data = data.select(*part, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else one).cast("long").alias("_w")).filter("_v is not null")
    n = F.sum("_w").alias("_n")
    ends = F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    first = data.groupBy(*part, magnitude(F.col("_v")).alias("_s")).agg(n, *ends)
    total = F.sum("_n").over(Window.partitionBy(*part))  # a row for each exponent
    at = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    whole = [g(at(p)).cast("long") for p in shares for g in (F.floor, F.ceil)]
    ranks = F.transform(F.array_distinct(F.array(*whole)), lambda r: F.struct(r.alias("_rank"), r.alias("_off")))
    sized = first.withColumn("_total", total)
    if few:
        return _few(data, sized.withColumn("_ranks", ranks), keys, part, shares, name)
    open_ = written(_found(sized.withColumn("_ranks", ranks), [*part, "_total"], "_s", F.col("_ranks")))
    done = []
    while True:
        done.append(open_.filter(_settled()).select(*part, "_total", "_rank", F.when(F.col("_off") == 0, F.col("_lo")).otherwise(F.col("_hi")).alias("v")))
        left = open_.filter(~_settled())
        if left.isEmpty():
            break
        wanted = left.groupBy(*part, "_total", "_lo", "_hi").agg(F.collect_list(F.struct("_rank", "_off")).alias("_ranks"))  # two for each share at most
        inside = same(data, wanted, part).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = _refined(inside, [*part, "_total"])
        open_ = written(_found(counts, [*part, "_total", "_least"], "_s", F.col("_ranks")).drop("_least"))
    values = done[0]
    for more in done[1:]:
        values = values.union(more)
    row = values.groupBy(*part, "_total").agg(F.map_from_entries(F.collect_set(F.struct("_rank", "v"))).alias("_m"))
    low, high = (lambda p: F.col("_m")[F.floor(at(p)).cast("long")]), (lambda p: F.col("_m")[F.ceil(at(p)).cast("long")])
    between = lambda p: F.when(low(p) == high(p), low(p)).otherwise(low(p) * (F.ceil(at(p)) - at(p)) + high(p) * (at(p) - F.floor(at(p))))
    return row.select(*keys, F.array(*[between(p) for p in shares]).alias(name))


def stacked(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column_name, value): the columns' numbers below one another, nulls left out."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.explode(rows).alias("_x")).select(*keys, "_x.*").filter("value is not null")


def medians(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, the columns' medians) of every group that has a value."""
    rows = stacked(df, columns, keys)
    long = quantiles(written(rows) if keys else rows, [*keys, "column_name"], "value", [0.5], few=not keys)
    pick = [F.max(F.when(F.col("column_name") == c, F.col("q")[0])).alias(c) for c in columns]
    return long.groupBy(*keys).agg(*pick)
