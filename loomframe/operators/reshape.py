"""Projection, filters and the wide-to-long reshape."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

YEAR_NAME = re.compile(r"(19|20)\d\d")


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if YEAR_NAME.fullmatch(c)]


def wide_to_long(df: DataFrame, year: str = "year", value: str = "value") -> DataFrame:
    """One row for each row and year column, nulls kept; unchanged where there is a year column already."""
    years = year_columns(df)
    if not years or year in df.columns:
        return df
    ids = [c for c in df.columns if c not in years]
    same = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in years])
    return same.unpivot(ids, years, year, value).withColumn(year, F.col(year).cast("int"))


def text_of(df: DataFrame, name: str) -> Column:
    """A column as text; nested values as their whole JSON, so that different values stay different."""
    if isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(F.col(name))
    return F.col(name).cast("string")


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns with dotted names; arrays stay."""

    def leaves(schema: T.StructType, path: tuple[str, ...] = ()):
        for field in schema:
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, (*path, field.name))
            else:
                yield (*path, field.name)

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema)])


def filter_equal(df: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows whose columns equal the wanted values; numbers by value, all else as text; unknown columns are passed over."""
    for name, value in wanted.items():
        if name not in df.columns:
            continue
        if isinstance(df.schema[name].dataType, T.NumericType):
            try:
                df = df.filter(F.col(name) == F.lit(float(value)))  # type: ignore[arg-type]
            except (TypeError, ValueError):
                df = df.filter(F.lit(False))
        else:
            df = df.filter(F.col(name).cast("string") == F.lit(str(value)))
    return df


def keep_original(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(f"{name}_original", F.col(name))


def recode(column: Column, coding: Mapping[str, str]) -> Column:
    """The code's meaning, null where the coding lacks it."""
    pairs = [F.lit(x) for item in coding.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), column.cast("string"))


def map_fields(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Only the mapped fields, under their target names."""
    return df.select(*[F.col(source).alias(target) for source, target in mapping.items()])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def preview(df: DataFrame, order: Sequence[str], n: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(n)
