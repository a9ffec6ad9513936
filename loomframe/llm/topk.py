"""Exact top-k by inner product with the threshold algorithm over sorted per-dimension lists.

Vectors are dealt to segments: those nearest to the same of a bounded number of pivots, by hash
where there are more of them than a segment holds.  A task takes one segment and one block of
queries.  It sorts the segment's vectors once for every dimension, in either direction, ties by
vec_id.  For each query it goes down all lists whose dimension has a weight, in the direction of
the weight's sign; vectors met for the first time are scored whole.  The scores of a vector not
met yet can't pass the bound, the inner product of the query with the last values of all lists.
The search stops once the bound is below the k-th score, or equals it while one of the lists has
passed the k-th id among equal values (a vector that ties with the bound stands further down in
every list, so its id is larger).

Every query first meets its own segment, whose k-th score is its floor in all others: a segment
whose bound is below the floor is left at once, and nothing below the floor is returned.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows with a null vec_id; an empty vector has a score of zero with every other; shorter vectors
are padded with zeros; rows that share a vec_id are vectors of their own, and each that is a
query has its own ranks; equal vectors tie and rank by vec_id; scaled components are held within
what makes every score fit in a long; fewer than k candidates are all returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_batches, discard, durable
from .vectors import scaled

SCALE = 256
K = 5
EVERY = 50
#: Vectors of a segment, queries of a block and pivots: what a task holds, and what the driver holds.
SEGMENT = 8192
QUERIES = 2048
MAX_PIVOTS = 256
#: Steps down each list before the first look at the bound; doubled each time.
STEP = 8


class Lists:
    """A segment's vectors in one order for each dimension and direction."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.order, self.x, self.ids = order, x[order], ids[order]  # equal scores then rank by place
        down, up = np.argsort(-self.x, axis=0, kind="stable"), np.argsort(self.x, axis=0, kind="stable")
        self.lists = np.hstack([down, up]).astype(np.int32)
        self.small = float(np.abs(x).max(initial=0)) * math.sqrt(max(1, x.shape[1])) < 2**26
        self.scored = self.x.astype(np.float64) if self.small else self.x  # floats multiply faster, and sums this small are exact

    def top(self, q: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores) of the k best for the query but ``own``, none below ``floor``; and how many vectors were scored."""
        dims = np.flatnonzero(q)
        weights, cols = q[dims], np.where(q[dims] > 0, dims, dims + len(q))
        n = len(self.x)
        small = self.small and float(np.abs(q).max(initial=0)) * math.sqrt(len(q)) < 2**26
        x, w = (self.scored, q.astype(np.float64)) if small else (self.x, q)
        met = np.zeros(n, bool)
        if own >= 0:
            met[own] = True
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, step, looked = 0, STEP, 0
        while at < n:
            ahead = self.lists[at, cols] if len(dims) else np.array([at])
            bound = int((self.x[ahead, dims] * weights).sum()) if len(dims) else 0  # what a vector not met yet has at most
            full = len(scores) >= k
            least = int(scores[-1]) if full else floor
            if least is not None and (bound < least or (full and bound == least and (ahead > places[-1]).any())):
                break
            new = np.zeros(n, bool)
            new[self.lists[at : at + step][:, cols] if len(dims) else np.arange(at, min(n, at + step))] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            looked += len(new)
            found = (x[new] @ w).astype(np.int64)
            if least is not None:
                new, found = new[found >= least], found[found >= least]
            places, scores = np.concatenate([places, new]), np.concatenate([scores, found])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
            at, step = at + step, step * 2
        return places, scores, looked


def _numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _searcher(k: int, dim: int):
    """One segment's vectors and one block of queries to (query, query_id, floor, score, vec_id)."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            lists = Lists(_numbers(left.column("x"), dim), left.column("id").to_numpy())
            place = {row: p for p, row in enumerate(left.column("row").to_numpy()[lists.order].tolist())}
            for row, i, q, floor in zip(right.column("row").to_pylist(), right.column("id").to_pylist(), _numbers(right.column("x"), dim), right.column("floor").to_pylist(), strict=True):
                places, scores, _ = lists.top(q, place.get(row, -1), k, floor)
                out += [(row, i, s, v) for s, v in zip(scores.tolist(), lists.ids[places].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query", "query_id", "score", "vec_id"])

    return search


def _nearest(pivots: np.ndarray):
    """The number of the nearest pivot beside each row (row, id, x)."""
    dim = pivots.shape[1]
    half = (pivots**2).sum(axis=1) / 2

    def run(batches):
        for batch in batches:
            x = _numbers(batch.column(2), dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((half - x @ pivots.T).argmin(axis=1), pa.int32())], names=["row", "id", "x", "pivot"])

    return run


def search(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, segment: int = SEGMENT, queries: int = QUERIES, max_pivots: int = MAX_PIVOTS, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for every row whose id ``every`` divides."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = vectors.agg(F.max(F.size(embedding))).first()[0] or 0
    dim = max(1, longest)
    rows = durable(scaled(vectors.filter(F.col(key).isNotNull()), scale, most=math.isqrt(2**62 // dim), key=key, embedding=embedding))
    n = rows.count()
    if not n:
        discard(rows)
        return empty
    p = max(1, min(max_pivots, n // segment))
    pivots = np.zeros((p, dim))
    for i, r in enumerate(rows.orderBy(F.xxhash64("x", F.lit(3)), "row").limit(p).select("x").collect()):  # max_pivots vectors at most
        pivots[i, : len(r[0])] = r[0]
    with arrow_batches(spark, 2048):
        at = durable(rows.mapInArrow(_nearest(pivots), "row long, id long, x array<long>, pivot int"))
    discard(rows)
    counts = dict(at.groupBy("pivot").count().collect())  # a number for each pivot
    cuts = [max(1, -(-counts.get(i, 0) // segment)) for i in range(p)]
    first = np.concatenate([[0], np.cumsum(cuts)]).tolist()

    def of(numbers: list[int]):
        return F.element_at(F.array(*map(F.lit, numbers)), F.col("pivot") + 1)

    at = at.withColumn("segment", (of(first[:-1]) + F.pmod(F.xxhash64("row"), of(cuts))).cast("int")).select("segment", "row", "id", "x")
    asked = at.filter(F.col("id") % every == 0).select(*[F.col(c).alias(c) for c in at.columns])  # columns of its own, for the cogroup
    blocks = max(1, -(-asked.count() // queries))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")
    cell, made = _searcher(k, dim), "query long, query_id long, score long, vec_id long"

    nothing = F.lit(None).cast("long").alias("floor")
    mine = at.groupBy("segment").cogroup(asked.select("segment", "row", "id", "x", nothing).groupBy("segment"))
    own = durable(mine.applyInArrow(cell, made))
    kth = own.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    asked = asked.join(kth.withColumnRenamed("query", "row"), "row", "left")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    if first[-1] == 1:
        return own.withColumn("rank", rank).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    others = F.filter(F.sequence(F.lit(0), F.lit(first[-1] - 1)), lambda s: s != F.col("segment"))
    asked = asked.withColumn("block", block).withColumn("segment", F.explode(others)).select("segment", "block", "row", "id", "x", "floor")
    dealt = at.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    far = dealt.groupBy("segment", "block").cogroup(asked.groupBy("segment", "block")).applyInArrow(cell, made)
    best = own.union(far).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
