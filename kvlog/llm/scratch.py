"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: Rows of one Arrow batch between the JVM and Python while a table is written; both sides hold a whole batch.
BATCH_ROWS = 500
#: Rows of one file of a table of narrow rows whose size is bounded beforehand.
FILE_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a single-JVM session that names none gets a folder of this machine; a cluster session without the
    setting is an error, because its executors do not see the driver's disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="llm-scratch-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Jobs started inside send at most ``rows`` rows in an Arrow batch; the session's own setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, most: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    ``most`` bounds the rows, if the caller knows a bound; a small table then becomes few files and its last stage
    few tasks, in proportion to the bound.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(-(-most // FILE_ROWS) or 1)
    path = scratch_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete every scratch table written so far; callers do this once results that read them are stored."""
    while _written:
        delete(*_written.pop())
