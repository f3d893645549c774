"""Which versions a compaction keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compact(log: DataFrame, watermark: int | None = None) -> DataFrame:
    """A full compaction.  Without a snapshot only the newest version of a key stays, if it is a value.  With the
    oldest snapshot at ``watermark`` all versions above it stay and the newest one at or below it, tombstone or not,
    so every view from the watermark on is unchanged."""
    if watermark is None:
        w = Window.partitionBy("user_key").orderBy(F.desc("seq"))
        return log.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r").where(~F.col("tombstone"))
    below = F.col("seq") <= watermark
    w = Window.partitionBy("user_key", below).orderBy(F.desc("seq"))
    return log.withColumn("__r", F.row_number().over(w)).where(~below | (F.col("__r") == 1)).drop("__r")


def prefix_merge(log: DataFrame) -> DataFrame:
    """A merge of the oldest runs only: newer runs are not seen, so every version stays."""
    return log


def retained(log: DataFrame, watermark: int | None = None) -> DataFrame:
    """One row: versions and bytes (keys and values) that a full compaction keeps."""
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return compact(log, watermark).agg(F.count("*").alias("versions"), F.coalesce(F.sum(size.cast("long")), F.lit(0).cast("long")).alias("bytes"))
