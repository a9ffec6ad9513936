"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a target by water-filling: weight shares of the whole size, stopped at
``cap`` times the source's own size, the excess reshared.  A source takes every document
``floor(target / size)`` times and, for what is left, once more each document whose hash lies
under a threshold.  The threshold comes from sums by source and hash bucket: the bucket in
which the running sum crosses the budget is refined, level by level, until it holds one hash.
No document is sorted, and a smaller budget's documents are a subset of a larger one's.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
rows that share a doc_id are drawn together; empty tables give empty results; other columns,
whatever their names, pass through ``mixed`` and ``mixture`` untouched; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import durable, hash60, n_words, text_of

LEVEL_BITS = 10
HASH_BITS = 60
WEIGHTS = (5, 2, 1)
CAP = 3.0


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, size, hash) of every document; narrow, so that refining rereads little."""
    return docs.select(F.col(source).alias("source"), n_words(text_of(text)).alias("size"), hash60(F.col(key)).alias("hash"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from one (source, size) row or more of each source.

    A capped source has cap * size / weight under the common level, so in the order of that
    ratio the level is the largest (rest of the total) / (rest of the weights).
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.select("source", "source_size", weight.alias("w")).select(
        "*", F.sum("source_size").over(whole).alias("total"), (F.lit(float(cap)) * F.col("source_size")).alias("most")
    )
    order = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level)
    return levels.select("source", "source_size", F.least("most", F.max("level").over(whole) * F.col("w")).alias("target"))


def thresholds(narrow: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row a source: source_size, target, full copies and the hash threshold of one copy more.

    ``narrow`` is what ``sized`` gives; it is read once a level, and each level's table of sources is written.
    """
    goal = targets(narrow, weights, cap)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goal.select("source", "source_size", "target", full.alias("copies")).select(
        "*", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix")
    )
    state = durable(state)
    n_sources, keep = state.count(), ["source_size", "target", "copies"]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        state = durable(_refine(narrow, state, keep, shift), n_sources)  # a plan of all levels grows with their square
    nearest = (F.col("ended") - F.col("rest")) < F.col("rest")
    return state.select("source", *keep, F.when(F.col("rest") > 0, F.col("prefix") + nearest.cast("long")).otherwise(0).alias("threshold"))


def _refine(narrow: DataFrame, state: DataFrame, keep: list[str], shift: int) -> DataFrame:
    """Each source's boundary bucket, split by the next bits: the new prefix and what is left before it."""
    known = state.select(F.col("source").alias("_s"), *keep, "rest", "prefix")
    inside = F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix")
    bucket = F.shiftright("hash", shift)
    counted = (
        narrow.join(known, F.col("source").eqNullSafe(F.col("_s")) & inside)
        .groupBy("source", *keep, "rest", bucket.alias("prefix"))
        .agg(F.sum("size").alias("n"))
    )
    run = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("reached", F.sum("n").over(run))
    crossing = F.col("reached") >= F.col("rest")
    best = F.min_by(F.struct("prefix", "reached", "n"), F.when(crossing, F.col("prefix")).otherwise(F.lit(2**62)))
    found = summed.groupBy("source", *keep, "rest").agg(best.alias("b"))
    return found.select(
        "source", *keep,
        (F.col("rest") - (F.col("b.reached") - F.col("b.n"))).alias("rest"),
        F.col("b.prefix").alias("prefix"), F.col("b.n").alias("ended"),
    )


def _free(columns: Sequence[str], name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def mixed(docs: DataFrame, plan: DataFrame, key: str = "doc_id", source: str = "source", into: str = "_mix") -> DataFrame:
    """``docs`` with a struct ``into`` (source_size, target, copies): how often the mix takes each row."""
    at = plan.select(F.struct("*").alias("_plan"))
    _plan = at["_plan"]
    once_more = (hash60(docs[key]) < _plan["threshold"]).cast("long")
    took = F.struct(_plan["source_size"].alias("source_size"), _plan["target"].alias("target"), (_plan["copies"] + once_more).alias("copies"))
    return docs.join(at, docs[source].eqNullSafe(_plan["source"])).select(*[docs[f"`{c}`"] for c in docs.columns], took.alias(into))


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    plan = thresholds(durable(sized(docs)), weights, cap)
    into = _free(docs.columns, "_mix")
    rows = mixed(docs, plan, into=into)
    copy = _free(rows.columns, "_copy")
    copies = F.explode(F.sequence(F.lit(1), F.col(f"{into}.copies"))).alias(copy)
    return rows.filter(F.col(f"{into}.copies") > 0).select(*[F.col(f"`{c}`") for c in docs.columns], copies).drop(copy)


def report(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    narrow = durable(docs.select("doc_id", F.col("source"), n_words(text_of()).alias("size"), hash60(F.col("doc_id")).alias("hash")))
    rows = mixed(narrow, thresholds(narrow, weights, cap))
    return rows.select("doc_id", "size", F.col("_mix.source_size").alias("source_size"), F.col("_mix.target").alias("target"), (F.col("size") * F.col("_mix.copies")).alias("taken"))
