"""Incremental collection: what is new or changed against a table of states, in batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

#: Fields of which one that equals the known state's means that nothing changed.
MARKS = ("etag", "last_modified", "text_hash")


def with_state(rows: DataFrame, state: DataFrame, key: str = "url", marks: Sequence[str] = MARKS) -> DataFrame:
    """``rows`` with ``skip``: whether a mark that both sides have equals the one in ``state``.

    ``state`` has one row for each key; a key without state, or null, is never skipped.
    """
    known = state.select(F.col(key).alias("_key"), *[F.col(m).alias(f"_{m}") for m in marks if m in state.columns])
    same = F.lit(False)
    for m in marks:
        if m in rows.columns and m in state.columns:
            same = same | F.coalesce(F.col(m) == F.col(f"_{m}"), F.lit(False))
    return rows.join(known, rows[key] == known["_key"], "left").select(*[rows[c] for c in rows.columns], same.alias("skip"))


def changes(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``rows`` with ``changed``: whether the key is new or its value differs from the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return rows.withColumn("changed", first | ~F.col(value).eqNullSafe(F.lag(value).over(w)))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """One row for each key of ``rows`` that ``seen`` lacks; the row with the least other columns where keys repeat."""
    fresh = rows.join(seen.select(key).distinct(), key, "left_anti")
    others = [c for c in rows.columns if c != key]
    if not others:
        return fresh.distinct()
    return fresh.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(key, "_row.*").select(*rows.columns)


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: a state table after its upserts."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*key, "_row.*")


def experience(rows: DataFrame, key: str, order: Sequence[str], success: str, enough: int = 2) -> DataFrame:
    """Successes, failures and status of each key.

    From ``enough`` successes on a success makes VERIFIED, from ``enough`` failures on a failure makes STALE; the last
    such event holds, other events change nothing, and a key with neither is UNVERIFIED.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    won, lost = F.count_if(F.col(success)).over(w), F.count_if(~F.col(success)).over(w)
    state = F.when(F.col(success) & (won >= enough), "VERIFIED").when(~F.col(success) & (lost >= enough), "STALE")
    told = rows.select(key, F.col(success).alias("_s"), state.alias("_state"), F.struct(*order).alias("_at"))
    status = F.coalesce(F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_at"))), F.lit("UNVERIFIED"))
    return told.groupBy(key).agg(F.count_if("_s").alias("successes"), F.count_if(~F.col("_s")).alias("failures"), status.alias("status"))


def within_quota(rows: DataFrame, day: str, order: Sequence[str], size: str, most: float, step: Column | None = None) -> DataFrame:
    """``rows`` with the running total of their day and whether it stays within the quota.

    ``step`` is a coarser form of ``order`` (an hour, a minute): totals then run over a day's steps, which
    are few, and over the rows within each step, so that a busy day is no single task.
    """
    if step is None:
        w = Window.partitionBy(day).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("used", F.sum(size).over(w)).withColumn("allowed", F.col("used") <= most)
    stepped = rows.withColumn("_step", step)
    ahead = Window.partitionBy(day).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    sums = stepped.groupBy(day, "_step").agg(F.sum(size).alias("_sum")).select(F.col(day).alias("_day"), F.col("_step").alias("_at"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    met = stepped.join(sums, F.col(day).eqNullSafe(F.col("_day")) & F.col("_step").eqNullSafe(F.col("_at")))
    within = Window.partitionBy(day, "_step").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = met.withColumn("used", F.col("_before") + F.sum(size).over(within))
    return used.withColumn("allowed", F.col("used") <= most).drop("_step", "_day", "_at", "_before")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Everything that the source holds now, written to Parquet at ``path``; a rerun goes on where this one ended."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    query = (writer.partitionBy(*partition_by) if partition_by else writer).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """``step`` on each micro-batch of what the source holds now."""
    query = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: States in which a task, run, download or build was when its process stopped, and where it goes on from.
RECOVERY = {("provider_task", "queued"): "cancelled", ("provider_task", "running"): "cancelled", ("search_run", "SEARCHING"): "PROVIDERS_SELECTED", ("download", "DOWNLOADING"): "FAILED", ("download", "QUEUED"): "FAILED"}


def reconciled(tasks: DataFrame, kind: str = "kind", status: str = "status") -> DataFrame:
    """``tasks`` after a restart: what was under way is failed or put back, with ``recovered`` where that was done; builds stay and resume from checkpoints."""
    goes = F.create_map(*[x for (k, s), to in RECOVERY.items() for x in (F.lit(f"{k}/{s}"), F.lit(to))])
    found = F.try_element_at(goes, F.concat_ws("/", F.col(kind), F.col(status)))
    return tasks.withColumns({"recovered": found.isNotNull(), status: F.coalesce(found, F.col(status))})


def first_backend(attempts: DataFrame, task: str, backend: str, ok: str, order: Sequence[str]) -> DataFrame:
    """(task, backend, trail): the first backend in ``order`` that succeeded for each task, and what was tried up to it."""
    place = F.array_position(F.array(*[F.lit(b) for b in order]), F.col(backend))
    tried = attempts.filter(place > 0).groupBy(task).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col(backend).alias("backend"), F.col(ok).alias("ok")))).alias("tried"))  # a row a backend
    won = F.try_element_at(F.filter("tried", lambda x: x["ok"]), F.lit(1))
    upto = F.filter("tried", lambda x: won["place"].isNull() | (x["place"] <= won["place"]))
    return tried.select(task, won["backend"].alias("backend"), F.array_join(F.transform(upto, lambda x: F.concat(x["backend"], F.when(x["ok"], ":success").otherwise(":failed"))), ",").alias("trail"))


def search_posts(posts: DataFrame, query: str, text: str, order: Sequence[str], start: int = 0, most: int = 20) -> DataFrame:
    """A page of the posts that hold any of the query's words, in ``order``."""
    found = F.lit(False)
    for word in query.lower().split():
        found = found | F.contains(F.lower(F.col(text)), F.lit(word))
    return posts.filter(found).orderBy(*order).offset(start).limit(most)
