"""Column profiles in one pass over the data, and roles guessed from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from . import rank
from .aggregate import top_values
from .reshape import text_of

# Column names that tell a role.
TIME_NAMES = ("year", "年份", "date", "日期", "time", "period", "quarter", "month")
PLACE_NAMES = ("country", "country_name", "nation", "country_code", "iso3", "iso2", "geo", "ref_area", "reporter", "partner", "province", "province_name", "province_code", "prov", "region", "省份", "city", "city_name", "city_code", "prefecture", "prefecture_name", "prefecture_code", "城市", "地级市")
ID_NAMES = ("id", "uid", "objectid", "fid")
NUMBER_TEXT = r"^[\d.,\-]+$"

QUARTERS = (0.25, 0.5, 0.75)
#: Columns profiled in one aggregate, so that its expression stays small for wide frames.
AT_ONCE = 50


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _facts(df: DataFrame, c: str, sketched: bool) -> Column:
    number = _is_number(df, c)
    value = F.col(c).cast("double") if number else text_of(df, c)
    null = F.lit(None).cast("double")
    return F.struct(
        F.lit(c).alias("column_name"),
        F.lit(df.schema[c].dataType.simpleString()).alias("type"),
        F.lit(number).alias("is_numeric"),
        F.count("*").alias("n_rows"),
        F.count_if(value.isNull()).alias("n_null"),
        *([F.approx_count_distinct(value).alias("n_unique")] if sketched else []),
        (F.min(value) if number else null).alias("v_min"),
        (F.max(value) if number else null).alias("v_max"),
        (F.avg(value) if number else null).alias("mean"),
        *([(F.percentile_approx(value, list(QUARTERS)) if number else F.lit(None).cast("array<double>")).alias("q")] if sketched else []),
        (null if number else F.avg(value.rlike(NUMBER_TEXT).cast("double"))).alias("number_text"),
        (null if number else F.avg(value.rlike(r"[\x{4e00}-\x{9fff}]").cast("double"))).alias("han_text"),
    ).alias(c)


def _one_pass(df: DataFrame, names: Sequence[str], sketched: bool) -> DataFrame:
    out = None
    for at in range(0, len(names), AT_ONCE):
        part = names[at : at + AT_ONCE]
        row = df.agg(*[_facts(df, c, sketched) for c in part]).select(F.explode(F.array(*part)).alias("x")).select("x.*")
        out = row if out is None else out.union(row)
    return out


def _exact(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, n_unique, q): exact, from the counts of all columns' values, made in one pass."""
    numbers, texts = [c for c in names if _is_number(df, c)], [c for c in names if not _is_number(df, c)]
    parts = []
    if numbers:
        counts = written(rank.stacked(df, numbers).groupBy("column_name", "value").agg(F.count("*").alias("n")))
        q = rank.quantiles(counts, ["column_name"], "value", QUARTERS, weight="n", few=True)
        parts.append(counts.groupBy("column_name").agg(F.count("*").alias("n_unique")).join(F.broadcast(q), "column_name"))
    if texts:
        rows = F.array(*[F.struct(F.lit(c).alias("column_name"), text_of(df, c).alias("value")) for c in texts])
        values = df.select(F.explode(rows).alias("x")).select("x.*").filter("value is not null").distinct()
        parts.append(values.groupBy("column_name").agg(F.count("*").alias("n_unique"), F.lit(None).cast("array<double>").alias("q")))
    return reduce(DataFrame.union, parts)


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """A row a column: nulls, distinct values, range, quartiles, text patterns and hints.

    Distinct values and quartiles are sketched in the one pass that gives the rest.  With
    ``exact`` they come from the counts of all columns' values, dealt by value.
    """
    names = list(columns or df.columns)
    out = _one_pass(df, names, not exact)
    if exact:
        out = out.join(F.broadcast(_exact(df, names)), "column_name", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0).cast("long")))  # a row a column
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        "column_name", "type", "is_numeric", "n_rows", "n_null",
        F.round(share(F.col("n_null"), F.col("n_rows")), 4).alias("missing_rate"),
        "n_unique",
        F.round(share(F.col("n_unique"), F.col("n_rows")), 4).alias("cardinality_ratio"),
        F.round("v_min", 6).alias("v_min"), F.round("v_max", 6).alias("v_max"), F.round("mean", 6).alias("mean"),
        *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75"))],
        F.coalesce(F.col("number_text") > 0.8, F.lit(False)).alias("numeric_text"),
        F.coalesce(F.col("han_text") > 0.2, F.lit(False)).alias("han_text"),
        (~F.col("is_numeric") & F.col("n_unique").between(2, 20)).alias("categorical"),
        unit_hint(F.col("column_name"), F.col("v_max")).alias("unit_hint"),
    )


def unit_hint(name: Column, most: Column) -> Column:
    n = F.lower(name)
    rate = n.rlike("rate|percent|pct|share|ratio")
    return (
        F.when(rate & (most <= 1.5), "fraction").when(rate, "percent").when(n.rlike("usd|dollar"), "usd").when(n.rlike("cny|rmb|yuan"), "cny").when(n.rlike("eur"), "eur")
    )


def roles(profiled: DataFrame) -> DataFrame:
    """(column_name, role flags) from a profile: time, place, identifier and key."""
    n = F.lower("column_name")
    return profiled.select(
        "column_name",
        (n.isin(*TIME_NAMES) | n.endswith("_year")).alias("likely_time"),
        (n.isin(*PLACE_NAMES) | n.contains("country") | n.contains("iso")).alias("likely_place"),
        (n.isin(*ID_NAMES) | n.endswith("_id") | (n.endswith("id") & F.col("is_numeric"))).alias("likely_id"),
        ((F.col("n_unique") == F.col("n_rows")) & (F.col("n_null") == 0)).alias("likely_key"),
    )


def frequent_values(df: DataFrame, k: int = 5) -> DataFrame:
    return top_values(df, [c for c in df.columns if not _is_number(df, c)], k)
