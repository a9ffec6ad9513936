"""Equi-joins guarded by key cardinality, with coverage reports, and keyless appends.

The guard is one aggregate over the two sides' counts by key, which gives duplicates, the
cardinality, the exact size of the result and the matches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def _counts(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def _present(keys: Sequence[str]):
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def require_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> None:
    for side, df in (("left", left), ("right", right)):
        if gone := [k for k in keys if k not in df.columns]:
            raise EngineError("JOIN_KEY_MISSING", f"{side} side lacks {gone}", side=side, keys=gone)


def key_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, null-key rows, duplicates, distinct keys and matches of both sides, and the joined rows."""
    require_keys(left, right, keys)
    full = _counts(left, keys, "l").join(_counts(right, keys, "r"), list(keys), "full_outer")
    has = _present(keys)
    l, r = F.coalesce(F.col("l"), F.lit(0)), F.coalesce(F.col("r"), F.lit(0))

    def total(c):
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    out = full.agg(
        total(l).alias("rows_left"),
        total(r).alias("rows_right"),
        total(F.when(~has, l).otherwise(0)).alias("null_left"),
        total(F.when(~has, r).otherwise(0)).alias("null_right"),
        total(F.when(has & (l > 1), l - 1).otherwise(0)).alias("dup_left"),
        total(F.when(has & (r > 1), r - 1).otherwise(0)).alias("dup_right"),
        F.count_if(has & (l > 0)).alias("keys_left"),
        F.count_if(has & (r > 0)).alias("keys_right"),
        F.count_if(has & (l > 0) & (r > 0)).alias("keys_matched"),
        total(F.when(has, l * r).otherwise(0)).alias("estimated_rows"),
    )
    one = lambda c: F.when(F.col(c) > 0, "m").otherwise("1")
    return out.select(
        "*",
        F.concat_ws(":", one("dup_left"), one("dup_right")).alias("cardinality"),
        (F.col("estimated_rows") > 10 * F.greatest("rows_left", "rows_right")).alias("cartesian_risk"),
    )


def join_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row about the inner join: matches, unmatched distinct keys, coverage and explosion."""
    k = key_report(left, right, keys)
    after = F.col("estimated_rows")
    return k.select(
        F.col("cardinality"),
        F.col("rows_left").alias("row_count_before"),
        after.alias("row_count_after"),
        after.alias("matched"),
        (F.col("keys_left") - F.col("keys_matched")).alias("unmatched_left"),
        (F.col("keys_right") - F.col("keys_matched")).alias("unmatched_right"),
        (F.col("null_left") + F.col("null_right")).alias("null_key_rows_dropped"),
        F.when(after > 0, 1.0).otherwise(0.0).alias("coverage"),
        F.round(F.coalesce(F.try_divide(F.col("keys_matched"), F.col("keys_left")), F.lit(0.0)), 4).alias("left_coverage"),
        ((after > 3 * F.col("rows_left")) & (after - F.col("rows_left") > 100)).alias("explosion"),
    )


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], limit: int | None = 10) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` lacks, as ``k1|k2`` text; the first ``limit`` in order as a report."""
    out = left.na.drop(subset=list(keys)).select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")
    out = out.select(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("sample"))
    return out if limit is None else out.orderBy("sample").limit(limit)


@dataclass(frozen=True)
class Joined:
    df: DataFrame
    report: dict


def safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", allow_mm: bool = False, drop_null_keys: bool | None = None, expected: str | None = None) -> Joined:
    """The join, unless both sides repeat keys and ``allow_mm`` is not given.

    An inner join never matches null keys.  For other kinds, rows with null keys stay unless
    ``drop_null_keys`` is set.  Right columns whose names the left has get the suffix ``_right``.
    """
    keys = list(keys)
    report = key_report(left, right, keys).first().asDict()
    if report["cardinality"] == "m:m" and not allow_mm:
        raise EngineError("JOIN_CARDINALITY_BLOCKED", f"both sides repeat {keys}", **report)
    if expected and expected != report["cardinality"]:
        raise EngineError("JOIN_CARDINALITY_BLOCKED", f"expected {expected}, found {report['cardinality']}", **report)
    return Joined(joined(left, right, keys, how, drop_null_keys), report)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", drop_null_keys: bool | None = None) -> DataFrame:
    """The lazy join itself, without the guard."""
    keys = list(keys)
    if drop_null_keys:
        left, right = left.na.drop(subset=keys), right.na.drop(subset=keys)
    taken = set(left.columns)
    right = right.withColumnsRenamed({c: f"{c}_right" for c in right.columns if c in taken and c not in keys})
    return left.join(right, keys, how)


def join_all(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "inner") -> Joined:
    """All frames, left to right, each step guarded."""
    done = Joined(frames[0], {})
    for df in frames[1:]:
        done = safe_join(done.df, df, keys, how)
    return done


def append(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of all columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.select("*") for f in frames])


def lookup(df: DataFrame, table: DataFrame, on: str, bound: int = 100_000) -> DataFrame:
    """``df`` with a dictionary's columns; the dictionary is broadcast only where it has at most ``bound`` rows."""
    small = table.limit(bound + 1).count() <= bound
    return df.join(F.broadcast(table) if small else table, on, "left")
