"""Missing-value policies, each with a mask of what it filled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from ..scratch import written
from . import rank

METHODS = ("none", "drop", "ffill", "bfill", "linear", "group_linear", "mean", "median")


def _window(group: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*group).orderBy(*order)


def _ways(group: Sequence[str], place: str) -> tuple[Window, Window]:
    """The rows up to each one, and those from it on, by their places.

    Both frames grow: the second runs over the places in reverse, since a frame that ends with
    its partition is read anew for every row and takes the square of the partition's rows.
    """
    return tuple(_window(group, [o]).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(place), F.desc(place)))


def _around(df: DataFrame, column: str, place: Column, back: Window, ahead: Window) -> tuple[DataFrame, Column, Column]:
    """``df`` with the nearest known values of ``column`` and their places, before and after each row, itself included."""
    known = F.when(F.col(column).isNotNull(), F.struct(place.alias("p"), F.col(column).alias("v")))
    before, after = f"_before_{column}", f"_after_{column}"
    return df.withColumn(before, F.last(known, True).over(back)).withColumn(after, F.last(known, True).over(ahead)), F.col(before), F.col(after)


def _taken(value: Column, before: Column, after: Column, at: Column, method: str, limit: int | None) -> Column:
    if method in ("linear", "group_linear"):
        return _inner(value, before, after, at, limit)
    return F.coalesce(value, (before if method == "ffill" else after)["v"])


def _inner(value: Column, before: Column, after: Column, at: Column, limit: int | None) -> Column:
    """By position between the neighbours that have a value; after the last one its value, before the first null."""
    inner = before["v"] + (after["v"] - before["v"]) * (at - before["p"]) / (after["p"] - before["p"])
    filled = F.when(before.isNull(), F.lit(None).cast("double")).when(after.isNull(), before["v"]).otherwise(inner)
    if limit is not None:
        filled = F.when(at - before["p"] <= limit, filled)
    return F.coalesce(value.cast("double"), filled)


def _carried(df: DataFrame, columns: Sequence[str], method: str, order: Sequence[str], limit: int | None) -> tuple[DataFrame, dict[str, Column]]:
    """A fill along an order of all rows, in ranges of it.

    Rows are dealt to ranges, numbered in them and written.  Each range sums up its rows to their number and its
    first and last known values with their places; what comes before and after a range follows
    from the sums of the others, a row for each range, and goes to its rows by a broadcast join.
    """
    ranges = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    at = written(ranges.withColumn("_place", F.row_number().over(_window(["_part"], order)).cast("long")))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_place").alias("p"), F.col(c).alias("v"))) for c in columns}
    sums = at.groupBy("_part").agg(F.count("*").alias("n"), *[g(k).alias(f"{name}_{c}") for c, k in known.items() for name, g in (("first", F.min), ("last", F.max))])
    rows, start = sorted(sums.collect(), key=lambda r: r["_part"]), 0  # a row for each range
    carry = []
    for r in rows:
        carry.append({"_part": r["_part"], "_start": start})
        start += r["n"]
    for c in columns:
        for name, way in (("last", range(len(rows))), ("first", range(len(rows) - 1, -1, -1))):
            seen = None
            for i in way:
                carry[i][f"_{name}_{c}"] = seen
                if rows[i][f"{name}_{c}"] is not None:
                    seen = (carry[i]["_start"] + rows[i][f"{name}_{c}"]["p"], rows[i][f"{name}_{c}"]["v"])
    schema = "_part int, _start long" + "".join(f", `_{name}_{c}` struct<p: long, v: {df.schema[c].dataType.simpleString()}>" for c in columns for name in ("last", "first"))
    names = ["_part", "_start", *[f"_{name}_{c}" for c in columns for name in ("last", "first")]]
    sent = df.sparkSession.createDataFrame([tuple(r[x] for x in names) for r in carry], schema)
    base = at.join(F.broadcast(sent), "_part")
    back, ahead = _ways(["_part"], "_place")
    place, done = F.col("_start") + F.col("_place"), {}
    for c in columns:
        base, before, after = _around(base, c, place, back, ahead)
        before, after = F.coalesce(before, F.col(f"_last_{c}")), F.coalesce(after, F.col(f"_first_{c}"))
        done[c] = _taken(F.col(c), before, after, place, method, limit)
    return base, done


def fill(df: DataFrame, columns: Sequence[str], method: str, group: Sequence[str] = (), order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """``df`` with the policy applied and, but for none and drop, a column ``__imputed_<name>`` for each.

    ``linear`` runs within ``group`` where one is given; ``group_linear`` demands one.  Fills
    along an order without a group carry known values over ranges of the order, see ``_carried``.
    """
    if method not in METHODS:
        raise EngineError("BUILD_FAILED", f"unknown missing policy {method!r}")
    if method == "group_linear" and not group:
        raise EngineError("BUILD_FAILED", "group_linear needs group columns")
    if method == "none":
        return df
    if method == "drop":
        return df.na.drop(subset=list(columns))
    done = {}
    if method in ("mean", "median"):
        facts = df.groupBy(*group).agg(*[F.avg(c).alias(c) for c in columns]) if method == "mean" else rank.medians(df, columns, group)
        facts = facts.select(*group, *[F.col(c).alias(f"_fill_{c}") for c in columns])
        base = df.join(facts, list(group), "left") if group else df.crossJoin(F.broadcast(facts))  # one row
        done = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill_{c}")) for c in columns}
    elif not group:
        base, done = _carried(df, columns, method, order, limit)
    else:
        base, at = df.withColumn("_at", F.row_number().over(_window(group, order))), F.col("_at")
        back, ahead = _ways(group, "_at")
        for c in columns:
            base, before, after = _around(base, c, at, back, ahead)
            done[c] = _taken(F.col(c), before, after, at, method, limit)
    kept = [c for c in df.columns if c not in columns]
    filled = base.select(*kept, *[F.col(c).alias(f"_was_{c}") for c in columns], *[done[c].alias(c) for c in columns])
    masks = [(F.col(f"_was_{c}").isNull() & F.col(c).isNotNull()).alias(f"__imputed_{c}") for c in columns]
    return filled.select(*df.columns, *masks)


def imputed_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_imputed, imputed_ratio of what was missing) from the masks."""
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__imputed_{c}").alias("filled"), F.col(c).isNull().alias("open")) for c in columns])
    long = df.select(F.explode(rows).alias("x")).select("x.*").groupBy("column_name")
    out = long.agg(F.count_if("filled").alias("n_imputed"), F.count_if(F.col("filled") | F.col("open")).alias("n_missing"))
    return out.select("column_name", "n_imputed", F.round(F.coalesce(F.try_divide("n_imputed", "n_missing"), F.lit(0.0)), 4).alias("imputed_ratio"))
