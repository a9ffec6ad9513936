"""Several sources searched at once, each as a tagged job of its own with a time limit; one that fails or hangs leaves the others alone."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from threading import Timer

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins
from ..scratch import shared_folder

Search = Callable[[SparkSession], DataFrame]
STATUS = "provider string, status string, n_rows long, error string"


@dataclass(frozen=True)
class Found:
    """The rows that were found, with their ``provider``, and a row for each source: success, failed or timeout."""

    rows: DataFrame | None
    tasks: DataFrame


def search_all(spark: SparkSession, sources: Mapping[str, Search], most: int = 6, seconds: float = 45.0) -> Found:
    """At most ``most`` sources run at once; each writes its rows, and after ``seconds`` its jobs are cancelled by their tag."""
    sc, run = spark.sparkContext, uuid.uuid4().hex
    folder = shared_folder(spark)

    def one(name: str, search: Search) -> tuple[str, str, int, str | None]:
        tag, path = f"{run}-{uuid.uuid5(uuid.NAMESPACE_OID, name).hex}", f"{folder}/{uuid.uuid5(uuid.NAMESPACE_OID, name).hex}"
        late: list[bool] = []

        def stop() -> None:
            late.append(True)
            sc.cancelJobsWithTag(tag)

        timer = Timer(seconds, stop)
        sc.addJobTag(tag)
        timer.start()
        began = time.monotonic()
        try:
            search(spark).write.parquet(path)
            if time.monotonic() - began > seconds:
                late.append(True)
                return name, "timeout", 0, f"no answer within {seconds:g} s"
            return name, "success", spark.read.parquet(path).count(), None  # from the files' footers
        except Exception as e:  # what a source raises is a row, not an end
            if late:
                return name, "timeout", 0, f"no answer within {seconds:g} s"
            return name, "failed", 0, (str(e).strip().splitlines() or [type(e).__name__])[0][:500]
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    with ThreadPoolExecutor(max_workers=most) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(lambda x: one(*x)), sources.items()))
    parts = [spark.read.parquet(f"{folder}/{uuid.uuid5(uuid.NAMESPACE_OID, n).hex}").withColumn("provider", F.lit(n)) for n, status, _, _ in done if status == "success"]
    return Found(joins.append(parts) if parts else None, spark.createDataFrame(done, STATUS))
