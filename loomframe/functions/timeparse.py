"""Time values in text: year, day, quarter, month and fiscal year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

# The patterns of the time notations, in the order in which they are tried.
YEAR = r"^(20\d\d|19\d\d)\s*年?$"
DAY = r"^(20\d\d|19\d\d)[-/](\d{1,2})[-/](\d{1,2})$"
QUARTER = r"(?i)^(20\d\d|19\d\d)\s*[-/Q季度]*\s*([1-4])\s*季?度?Q?$"
MONTH = r"^(20\d\d|19\d\d)\s*年?\s*[-/]?\s*(\d{1,2})\s*月?$"
FISCAL = r"^(?:FY|fy|财年)\s*(20\d\d|19\d\d)(?:/(\d\d))?$"

GRANULARITIES = ("year", "quarter", "month", "day", "fiscal_year")
TIME_NAMES = ("time", "date", "period", "quarter", "month")


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def time_value(raw: Column) -> Column:
    """Struct (granularity, year, quarter, month, day) of a value's text; null where nothing fits."""
    t = F.trim(raw.cast("string"))
    none = F.lit(None).cast("int")

    def value(kind: str, pattern: str, quarter: Column = none, month: Column = none, day: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("granularity"), _number(t, pattern, 1).alias("year"), quarter.alias("quarter"), month.alias("month"), day.alias("day"))

    named = F.lower(t).contains("q") | t.contains("季")
    month = _number(t, MONTH, 2)
    return (
        F.when(t.rlike(YEAR), value("year", YEAR))
        .when(t.rlike(DAY), value("day", DAY, month=_number(t, DAY, 2), day=_number(t, DAY, 3)))
        .when(t.rlike(QUARTER) & named, value("quarter", QUARTER, quarter=_number(t, QUARTER, 2)))
        .when(t.rlike(MONTH) & month.between(1, 12), value("month", MONTH, month=month))
        .when(t.rlike(FISCAL), value("fiscal_year", FISCAL))
    )


def with_time(df: DataFrame, name: str, into: str) -> DataFrame:
    """``df`` with the time values of a column as a struct ``into``.

    Each distinct text is parsed once and joined back; such texts are few, so the join is a
    broadcast where adaptive execution sees that they are.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        d = F.col(name)
        return df.withColumn(into, F.when(d.isNotNull(), F.struct(F.lit("day").alias("granularity"), F.year(d).alias("year"), F.lit(None).cast("int").alias("quarter"), F.month(d).alias("month"), F.day(d).alias("day"))))
    text = F.col(name).cast("long").cast("string") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name).cast("string")
    raw = f"{into}_raw"
    known = df.select(text.alias(raw)).distinct().groupBy(raw).agg(F.first(time_value(F.col(raw))).alias(into))  # the aggregate keeps filters from parsing again
    return df.withColumn(raw, text).join(known, raw, "left").drop(raw)


def granularity(raw: Column) -> Column:
    return F.coalesce(time_value(raw)["granularity"], F.lit("unknown"))


def year_of(df: DataFrame, name: str) -> Column:
    """The year of a column of any type: of numbers the whole part as text, of dates the year."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.year(name)
    text = F.col(name).cast("long").cast("string") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(name)
    return time_value(text)["year"]


def majority_granularity(df: DataFrame, name: str) -> DataFrame:
    """One row: the most frequent known granularity, ties in the order of GRANULARITIES."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GRANULARITIES]), F.col("g"))
    counted = df.select(time_value(F.col(name))["granularity"].alias("g")).filter("g is not null").groupBy("g").count()
    return counted.agg(F.coalesce(F.max_by("g", F.struct(F.col("count"), -rank)), F.lit("unknown")).alias("frequency"))


def frequency_conflict(a: Column, b: Column) -> Column:
    """Whether two known frequencies differ; null and ``unknown`` conflict with nothing."""
    known = lambda c: F.coalesce(c, F.lit("unknown"))
    return (known(a) != "unknown") & (known(b) != "unknown") & (known(a) != known(b))


def fiscal_to_year(raw: Column) -> Column:
    v = time_value(raw)
    return F.when(v["granularity"] == "fiscal_year", v["year"])


def find_time_column(df: DataFrame) -> str | None:
    """``year``, else a column with a time's name, else the first of whose 20 distinct values, drawn by hash, all parse."""
    if "year" in df.columns:
        return "year"
    for name in TIME_NAMES:
        if name in df.columns:
            return name
    for name in df.columns:
        sample = df.select(F.col(name).cast("string").alias("v")).filter("trim(v) != ''").distinct().orderBy(F.xxhash64("v"), "v").limit(20)
        n, bad = sample.agg(F.count("*"), F.count_if(time_value(F.col("v")).isNull())).first()
        if n and not bad:
            return name
    return None


def overlap_score(start: Column, end: Column, want_start: Column, want_end: Column) -> Column:
    """Share of the wanted years that a coverage has, 1 at most."""
    common = F.greatest(F.lit(0), F.least(end, want_end) - F.greatest(start, want_start))
    return F.least(F.lit(1.0), common / F.greatest(want_end - want_start, F.lit(1)))


def require_frequency(name: str) -> str:
    if name not in GRANULARITIES:
        raise EngineError("TIME_FREQUENCY_CONFLICT", f"unknown frequency {name!r}")
    return name
