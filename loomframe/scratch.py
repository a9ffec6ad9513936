"""Tables written in the folder that all executors share, to cut lineage or to be read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that the session names; a temporary folder only where it names none."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{where.rstrip('/')}/loomframe-{uuid.uuid4().hex}" if where else tempfile.mkdtemp(prefix="loomframe-")


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    path = f"{shared_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
