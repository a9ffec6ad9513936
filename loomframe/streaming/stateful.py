"""Collection as streams whose state is kept for each key: changes of pages and experience with sites.

State lives in the state store (RocksDB, in the stream's checkpoint), so a stream that was stopped
goes on where it ended.  Rows of one key within a micro-batch are taken in ``order``; batches are
taken as they come.  A state that was not touched for ``ttl_ms`` is forgotten, 0 keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The settings that keyed state needs, for streams that are started inside: its store, and no batches without rows, which state with a time to live would ask for without end."""
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Changes(StatefulProcessor):
    """The last value of each key; each row says whether its value differs from the one before."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], value: str, kind: str, ttl_ms: int):
        self.columns, self.order, self.value, self.kind, self.ttl_ms = list(columns), list(order), value, kind, ttl_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", f"v {self.kind}", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            now = row[self.value]
            yield Row(**{c: row[c] for c in self.columns}, changed=not known or now != last)
            known, last = True, now
        self.last.update((last,))

    def close(self) -> None:
        pass


def changes(stream: DataFrame, key: Sequence[str], order: Sequence[str], value: str, ttl_ms: int = 0) -> DataFrame:
    """``stream`` with ``changed``: whether the key is new or its value differs from the one before."""
    schema = T.StructType([*stream.schema, T.StructField("changed", T.BooleanType())])
    processor = _Changes(stream.columns, order, value, stream.schema[value].dataType.simpleString(), ttl_ms)
    return stream.groupBy(*key).transformWithState(processor, schema, "Append", "ProcessingTime" if ttl_ms else "None")


class _Experience(StatefulProcessor):
    """Successes, failures and status of each site."""

    def __init__(self, key: str, order: Sequence[str], success: str, enough: int, ttl_ms: int):
        self.key, self.order, self.success, self.enough, self.ttl_ms = key, list(order), success, enough, ttl_ms

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "won long, lost long, status string", self.ttl_ms or None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        won, lost, status = self.known.get() if self.known.exists() else (0, 0, "UNVERIFIED")
        for row in sorted(rows, key=lambda r: tuple(r[c] for c in self.order)):
            if row[self.success]:
                won += 1
                status = "VERIFIED" if won >= self.enough else status
            else:
                lost += 1
                status = "STALE" if lost >= self.enough else status
        self.known.update((won, lost, status))
        yield Row(**{self.key: key[0], "successes": won, "failures": lost, "status": status})

    def close(self) -> None:
        pass


def experience(stream: DataFrame, key: str, order: Sequence[str], success: str, enough: int = 2, ttl_ms: int = 0) -> DataFrame:
    """(key, successes, failures, status) of each key that a micro-batch touches; the last row of a key holds."""
    schema = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("successes", T.LongType()), T.StructField("failures", T.LongType()), T.StructField("status", T.StringType())])
    return stream.groupBy(key).transformWithState(_Experience(key, order, success, enough, ttl_ms), schema, "Append", "ProcessingTime" if ttl_ms else "None")
