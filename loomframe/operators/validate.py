"""Data-quality checks as rows (code, severity, field, affected), each family in one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import duplicate_rows
from .reshape import numeric_columns, text_of

# Variables that can't be negative.
NOT_NEGATIVE = ("gdp_per_capita", "population", "youth_unemployment_rate", "unemployment_rate", "age", "income")


def _rows(facts: DataFrame, *found: tuple[Column, str, str, str | None, Column]) -> DataFrame:
    """One row for each (condition, code, severity, field, affected) that holds."""
    made = [F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).cast("string").alias("field"), n.cast("long").alias("affected"))) for on, code, severity, field, n in found]
    return facts.select(F.explode(F.array_compact(F.array(*made))).alias("x")).select("x.*")


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.col("n_duplicates")
    name = ",".join(keys)
    return _rows(duplicate_rows(df, keys), (n > 0, "KEY_DUPLICATE", "ERROR", name, n), (n == 0, "KEY_UNIQUE", "INFO", name, n))


def check_duplicates(df: DataFrame) -> DataFrame:
    n = F.col("n_duplicates")
    return _rows(duplicate_rows(df.select(*[text_of(df, c).alias(c) for c in df.columns])), (n > 0, "DUPLICATE_ROWS", "WARNING", None, n))


def check_missing(df: DataFrame, columns: Sequence[str] | None = None, high: float = 0.5) -> DataFrame:
    names = list(columns or df.columns)
    facts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    found = []
    for c in names:
        much = F.col(c) > F.lit(high) * F.col("_rows")
        found += [(much, "MISSING_HIGH", "WARNING", c, F.col(c)), (~much & (F.col(c) > 0), "MISSING", "INFO", c, F.col(c))]
    return _rows(facts, *found)


def check_negative(df: DataFrame, columns: Sequence[str] = NOT_NEGATIVE) -> DataFrame:
    names = [c for c in columns if c in df.columns]
    if not names:
        return _rows(df.limit(1), (F.lit(False), "IMPOSSIBLE_VALUE", "ERROR", None, F.lit(0)))
    facts = df.agg(*[F.count_if(F.col(c).try_cast("double") < 0).alias(c) for c in names])
    return _rows(facts, *[(F.col(c) > 0, "IMPOSSIBLE_VALUE", "ERROR", c, F.col(c)) for c in names])


def check_outliers(df: DataFrame, columns: Sequence[str] | None = None, most: float = 6.0) -> DataFrame:
    """Values more than ``most`` standard deviations from a mean that isn't about zero."""
    names = list(columns or numeric_columns(df))
    facts = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(f"_{c}") for c in names])
    wide = df.select(*names).crossJoin(F.broadcast(facts))  # one row
    far = {c: F.abs((F.col(c) - F.col(f"_{c}.m")) / F.col(f"_{c}.s")) > most for c in names}
    usable = {c: (F.col(f"_{c}.s") != 0) & (F.abs(F.col(f"_{c}.m")) > 1e-9) for c in names}
    counts = wide.agg(*[F.count_if(usable[c] & F.when(usable[c], far[c]).otherwise(False)).alias(c) for c in names])
    return _rows(counts, *[(F.col(c) > 0, "OUTLIER", "WARNING", c, F.col(c)) for c in names])


def check_gaps(df: DataFrame, entity: str, year: str = "year") -> DataFrame:
    """Entity-years missing from all entities times all years from the first to the last."""
    y = F.col(year).try_cast("int")
    pairs = df.filter(F.col(entity).isNotNull() & y.isNotNull()).groupBy(F.col(entity).alias("e"), y.alias("y")).agg(F.lit(1).alias("one"))
    facts = pairs.agg(F.count("*").alias("have"), F.count_distinct("e").alias("n"), (F.max("y") - F.min("y") + 1).alias("span"))
    gap = F.coalesce(F.col("n") * F.col("span"), F.lit(0)) - F.col("have")
    return _rows(facts, (gap > 0, "TEMPORAL_GAP", "WARNING", year, gap), (gap == 0, "TEMPORAL_COMPLETE", "INFO", year, gap))


def check_constant(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with one value or none; least and greatest value tell, so nothing is counted distinct."""
    names = list(columns or df.columns)
    facts = df.agg(F.count("*").alias("_rows"), *[F.coalesce(F.min(text_of(df, c)) == F.max(text_of(df, c)), F.lit(True)).alias(c) for c in names])
    return _rows(facts, *[((F.col("_rows") > 1) & F.col(c), "CONSTANT_COLUMN", "WARNING", c, F.col("_rows")) for c in names])


def check_row_count(df: DataFrame, expected: int) -> DataFrame:
    facts = df.agg(F.count("*").alias("n"))
    off = F.abs(F.col("n") - expected)
    drift = off > max(10.0, 0.1 * expected)
    return _rows(facts, (drift, "ROW_COUNT_DRIFT", "ERROR", None, off), (~drift, "ROW_COUNT_STABLE", "INFO", None, off))


def check_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    spark = df.sparkSession
    have = dict(df.dtypes)
    bad = [("TYPE_DRIFT", "ERROR", c, 1) for c, kind in expected.items() if c in have and have[c] != kind]
    return spark.createDataFrame(bad, "code string, severity string, field string, affected long")


def check_join(report: DataFrame) -> DataFrame:
    """From a join report: coverage of the left side, and unmatched entities."""
    c, n = F.col("left_coverage"), F.col("unmatched_left") + F.col("unmatched_right")
    return _rows(report, (c < 0.8, "JOIN_COVERAGE_LOW", "WARNING", None, n), (c >= 0.8, "JOIN_COVERAGE", "INFO", None, n), (n > 0, "UNMATCHED_ENTITIES", "INFO", None, n))


def check_imputed(df: DataFrame) -> DataFrame:
    masks = [c for c in df.columns if c.startswith("__imputed_")]
    if not masks:
        return _rows(df.limit(1), (F.lit(False), "IMPUTATION_PRESENT", "INFO", None, F.lit(0)))
    facts = df.agg(*[F.count_if(c).alias(c) for c in masks])
    return _rows(facts, *[(F.col(c) > 0, "IMPUTATION_PRESENT", "INFO", c.removeprefix("__imputed_"), F.col(c)) for c in masks])


def validate(df: DataFrame, keys: Sequence[str], entity: str | None = None, year: str = "year", report: DataFrame | None = None, expected_rows: int | None = None, expected_types: Mapping[str, str] | None = None) -> DataFrame:
    """All checks that apply, as one table."""
    data = df.select(*[c for c in df.columns if not c.startswith("__imputed_")])
    parts = [check_keys(data, keys), check_duplicates(data), check_missing(data), check_negative(data), check_outliers(data), check_constant(data), check_imputed(df)]
    if entity and year in df.columns:
        parts.append(check_gaps(data, entity, year))
    if report is not None:
        parts.append(check_join(report))
    if expected_rows is not None:
        parts.append(check_row_count(data, expected_rows))
    if expected_types:
        parts.append(check_types(data, expected_types))
    return reduce(DataFrame.union, parts)
