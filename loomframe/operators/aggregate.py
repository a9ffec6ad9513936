"""Yearly aggregation with a method for each variable, and the counting aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.timeparse import with_time
from ..scratch import written
from . import rank

FINER = ("month", "quarter", "day")
METHODS = ("mean", "sum", "min", "max", "median", "first", "last", "weighted_mean", "none")


def method_expr(name: str, method: str, order: Column, weight: str | None = None) -> Column:
    """One variable's aggregate; first and last follow ``order`` and skip nulls, an all-null sum is 0."""
    c = F.col(name)
    plain = {"mean": F.avg, "min": F.min, "max": F.max}
    if method in plain:
        return plain[method](c)
    if method == "sum":
        return F.coalesce(F.sum(c), F.lit(0).cast("double"))
    if method in ("first", "none"):
        return F.min_by(c, F.when(c.isNotNull(), order))
    if method == "last":
        return F.max_by(c, F.when(c.isNotNull(), order))
    if method == "weighted_mean":
        if not weight:
            raise EngineError("TIME_FREQUENCY_CONFLICT", f"{name}: weighted_mean needs a weight")
        return F.try_divide(F.coalesce(F.sum(c * F.col(weight)), F.lit(0.0)), F.coalesce(F.sum(weight), F.lit(0.0)))
    raise EngineError("TIME_FREQUENCY_CONFLICT", f"{name}: unknown method {method!r}")


def to_year(df: DataFrame, time_col: str, methods: Mapping[str, str], group: Sequence[str] = (), weight: str | None = None, order: Sequence[str] = (), keep_years: bool = True) -> DataFrame:
    """One row for each group and year.

    Rows of months, quarters and days are aggregated; plain years too unless ``keep_years`` is
    off.  Rows whose time doesn't parse are left out.
    """
    kinds = [*FINER, "year"] if keep_years else list(FINER)
    rows = with_time(df, time_col, "_time").filter(F.col("_time.granularity").isin(kinds))
    at = F.struct("_time.year", "_time.quarter", "_time.month", "_time.day", *[F.col(c) for c in order])
    middle = [c for c, m in methods.items() if m == "median"]
    rest = [method_expr(c, m, at, weight).alias(c) for c, m in methods.items() if m != "median"]
    keys = [*group, "year"]
    done = rows.groupBy(*group, F.col("_time.year").alias("year")).agg(F.count("*").alias("_rows"), *rest)
    if middle:
        dated = rows.select(*group, F.col("_time.year").alias("year"), *middle)
        done = rank.same(done, rank.medians(dated, middle, keys), keys, "left")
    return done.select(*keys, *methods)


def duplicate_rows(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows, distinct keys and rows beyond the first of their key (all columns if none are named)."""
    rows = df.na.drop(subset=list(keys)) if keys else df
    counts = rows.groupBy(*(keys or df.columns)).agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return counts.agg(total("n").alias("n_rows"), F.count("*").alias("n_keys"), total(F.col("n") - 1).alias("n_duplicates"))


#: Values that a column's summary follows at first; Spark follows MOST at most.
FOLLOWED, MOST = 1000, 1_000_000


def _undercount(followed: int) -> float:
    """The share of all rows that a value which the summary doesn't hold has at most: 3.5 by the size of its map."""
    return 3.5 / 2 ** math.ceil(math.log2(followed / 0.75))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5, followed: int = FOLLOWED) -> DataFrame:
    """(column_name, value, n, place): each column's ``k`` most frequent values, ties by value.

    One pass keeps a mergeable summary of frequent values for each column, a second one counts
    only what the summaries hold.  That proves the result where the k-th count is above what a
    value outside of the summary can have; columns where it isn't are followed by ten times as
    many values, and those of which no summary can tell (most values as rare as the k-th) are
    counted whole, of which each task keeps ``k``.
    """
    value = lambda c: F.col(c).cast("string")
    rows = {c: n for c, n in zip(columns, df.agg(*[F.count(value(c)) for c in columns]).first(), strict=True)} if columns else {}
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
    done, open_ = [], [c for c in columns if rows[c]]
    while open_ and followed <= MOST:
        summary = df.agg(*[F.call_function("approx_top_k", value(c), F.lit(followed), F.lit(followed)).alias(c) for c in open_])
        held = F.explode(F.concat(*map(_items, open_)))
        held = summary.select(held.alias("x")).select("x.*").filter("value is not null")
        counts = written(_long(df, open_, value).join(F.broadcast(held), ["column_name", "value"]).groupBy("column_name", "value").agg(F.count("*").alias("n")))  # ``followed`` values a column at most
        facts = counts.groupBy("column_name").agg(F.sum("n").alias("all"), F.try_element_at(F.sort_array(F.collect_list("n"), False), F.lit(k)).alias("kth")).collect()
        sure = [r["column_name"] for r in facts if r["all"] == rows[r["column_name"]] or (r["kth"] or 0) > _undercount(followed) * rows[r["column_name"]]]
        done.append(counts.filter(F.col("column_name").isin(sure)))
        open_ = [c for c in open_ if c not in sure]
        flat = {r["column_name"] for r in facts if (r["kth"] or 0) <= _undercount(MOST) * rows[r["column_name"]]}
        if open_ and flat.issuperset(open_):
            break
        followed *= 10
    if open_:
        done.append(_long(df, open_, value).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    out = reduce(DataFrame.union, done) if done else df.sparkSession.createDataFrame([], "column_name string, value string, n long")
    return out.withColumn("place", place).filter(F.col("place") <= k)


def _items(c: str) -> Column:
    return F.transform(c, lambda x: F.struct(F.lit(c).alias("column_name"), x["item"].alias("value")))


def _long(df: DataFrame, columns: Sequence[str], value: Callable[[str], Column]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), value(c).alias("value")) for c in columns])).alias("x")).select("x.*").filter("value is not null")


def null_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_null, null_ratio) in one pass."""
    facts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in columns])
    return facts.select("_rows", F.explode(rows).alias("x")).select("x.column_name", "x.n_null", F.round(F.try_divide(F.col("x.n_null"), F.col("_rows")), 4).alias("null_ratio"))


def quantiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, min, q25, q50, q75, max, mean): exact; a pass for the ends and means, one for the counts of values, a few over these for the rest."""
    facts = df.agg(*[F.struct(F.min(c).cast("double").alias("v_min"), F.max(c).cast("double").alias("v_max"), F.avg(c).alias("mean")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("s")) for c in columns])
    ends = facts.select(F.explode(rows).alias("x")).select("x.column_name", "x.s.*")
    counts = written(rank.stacked(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    q = rank.quantiles(counts, ["column_name"], "value", [0.25, 0.5, 0.75], weight="n", few=True)
    met = ends.join(F.broadcast(q), "column_name", "left")  # a row for each column
    return met.select("column_name", "v_min", *[F.col("q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "v_max", "mean")


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
