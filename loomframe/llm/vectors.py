"""Scaled vectors for the operators that need whole numbers: floor(scale * x) of every component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(e: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    return F.coalesce(e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def scaled(vectors: DataFrame, scale: int, shift: int = 0, most: int = 2**31, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(row, id, x): usable vectors as longs floor(scale * x) + shift; what lies beyond +-most is held there.

    ``row`` numbers the rows and holds only if the result is written before it is used twice.
    """
    e = F.col("e")
    rows = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("e")).filter(usable(e))
    held = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-float(most))), F.lit(float(most)))).cast("long") + shift
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", F.transform(e, held).alias("x"))
