"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its own quantiles (strings whole, by the rows of every distinct value), the curve
index of the cell orders the rows, and runs of that order become shards.  Rows that are near
in every dimension share a shard, so a reader that filters on any of them prunes whole files.

The order is a range partitioning; a row's place is its partition's offset plus its place in
the partition, so neither one task nor the driver sees all rows.

Defined cases: a null in a dimension takes the lowest cell; a null text has size 1 (0 bytes,
plus 1); ties in the curve index are ordered by doc_id, then size and checksum, and rows equal
in all of these are interchangeable; a text of any length counts whole; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .base import shared_dir, text_of

#: Bits of each dimension; a dimension has 2 ** BITS cells.
BITS = 5
#: Places of a row within a partition, as monotonically_increasing_id numbers them.
ROW_BITS = 33


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (rows x dimensions), after Skilling's transpose form."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[:, i] & q) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(flip, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    index = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[:, i] >> b) & 1)
    return index


def curve(docs: DataFrame, dims: Sequence[str], bits: int = BITS) -> Column:
    """Curve index column of ``docs``; the edges are at most 2 ** bits values a dimension."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    texts = {d for d in dims if isinstance(docs.schema[d].dataType, T.StringType)}
    numbers = [d for d in dims if d not in texts]
    row = docs.agg(*[F.percentile_approx(docs[d].cast("double"), steps, 2000).alias(f"q{i}") for i, d in enumerate(numbers)]).first() if numbers else []
    edges: dict[str, list] = {d: np.unique(np.array(row[i] or [], dtype=float)).tolist() for i, d in enumerate(numbers)}
    edges |= {d: text_edges(docs, d, bits) for d in texts}

    def cell(d: str) -> Column:
        """How many edges lie at or below the value, spread over all cells where edges are few; a null has none below."""
        value = docs[d] if d in texts else docs[d].cast("double")
        at = F.size(F.filter(F.array(*[F.lit(e) for e in edges[d]]), lambda e: e <= value)) if edges[d] else F.lit(0)
        return (F.when(value.isNull(), 0).otherwise(at) * ((1 << bits) // (len(edges[d]) + 1))).cast("int")

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy(np.int64) for c in cols], axis=1), bits))

    return index(*[cell(d) for d in dims])


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` in ascending ``order`` with struct ``_at``: pos (long, from 0), sum of ``size`` before in its partition's offset."""
    shared_dir(rows.sparkSession)
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).checkpoint()
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id())
    counts = numbered.groupBy(F.shiftright("_id", ROW_BITS).alias("_p")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.sum("n").over(whole).alias("rows"), F.sum("b").over(whole).alias("bytes"),
    )
    joined = numbered.withColumn("_p", F.shiftright("_id", ROW_BITS)).join(offsets, "_p")  # a row a partition: few
    return joined.withColumn("pos", F.col("n0") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1))


def text_edges(docs: DataFrame, name: str, bits: int) -> list[str]:
    """Strings that cut a dimension's values into at most 2 ** bits runs of like numbers of rows.

    Every distinct value counts for all its rows.  The values are put in order over ranges; an edge
    is the value in whose rows a cut falls, so the driver gets the edges alone.
    """
    cells = 1 << bits
    counts = docs.select(docs[name].cast("string").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("size"))
    run = Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = placed(counts, ["v"]).select("v", "size", "bytes", (F.col("b0") + F.sum("size").over(run)).alias("upto"))
    # The first value that reaches bytes * k / cells for a k from 1 to cells - 1: the k's below its rows and those up to them differ.
    cuts = lambda upto: F.least(F.expr(f"({upto}) * {cells} div bytes"), F.lit(cells - 1))
    return sorted((r["v"] for r in reached.filter(cuts("upto") > cuts("upto - size")).toLocalIterator()), key=str.encode)


def shards(
    docs: DataFrame, n: int = 16, dims: Sequence[str] = ("source", "lang", "n_chars"), law: str = "rows", bits: int = BITS
) -> DataFrame:
    """doc_id, size, text_crc32, law, curve, shard, slot and grown_shard of every document.

    Law ``rows`` cuts runs of equal counts, ``bytes`` runs of near equal sizes.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law!r}")
    narrow = docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text_of()) + 1).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), curve(docs, dims, bits).alias("curve")
    )
    at = placed(narrow, ["curve", "doc_id", "size", "text_crc32"])
    if law == "rows":
        cut = at.withColumn("shard", F.expr(f"pos * {n} div rows").cast("int"))
        slot = F.col("pos") - F.expr(f"(shard * rows + {n - 1}) div {n}")
        done = cut.withColumn("slot", slot)
    else:
        run = Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        middle = F.col("b0") + F.sum("size").over(run) - F.col("size") / 2
        cut = at.withColumn("shard", F.least(F.floor(middle * n / F.col("bytes")), F.lit(n - 1)).cast("int"))
        firsts = cut.groupBy(F.col("shard").alias("_shard")).agg(F.min("pos").alias("first"))  # n rows at most
        done = cut.join(firsts, F.col("shard") == F.col("_shard")).withColumn("slot", F.col("pos") - F.col("first"))
    return done.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
