"""Shared helpers: durable intermediate tables, Arrow batch bounds, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Documents handed to a Python task at once; bounds a worker's memory.
BATCH_DOCS = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        where = tempfile.mkdtemp(prefix="loomframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


#: Rows of a file, and least number of files, of a written table whose rows are known to be few.
ROWS_A_FILE = 50_000
LEAST_FILES = 8


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, which cuts the lineage.

    ``rows`` is a bound on its rows, where there is one: a small table then gets few files, however many partitions it comes from.
    """
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loomframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``durable`` wrote for ``tables``, which nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.durable_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids up to which a table of them is broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 500_000


def among(rows: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``on`` is (left_semi) or isn't (left_anti) in ``ids``, a written table of one id column."""
    few = ids.count() <= BROADCAST_IDS  # a written table's count comes from its footers
    return rows.join(F.broadcast(ids) if few else ids, on, how)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, since one row may be a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_DOCS:
        spark.conf.set(key, str(BATCH_DOCS))


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = BATCH_DOCS) -> Iterator[None]:
    """Bound the rows of an Arrow batch for what is run inside; the session has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker lives on after a task: what the task no longer needs goes back to the machine."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # a C library without it keeps its memory
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the key's MD5, so that any engine can repeat the draw."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
