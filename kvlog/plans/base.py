"""What the driver queries share: events as a change log, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log: one key a user, an error event deletes."""
    gone = F.col("event_type") == "error"
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("user_key"), (F.col("event_id") + 1).alias("seq"), gone.alias("tombstone"), F.when(~gone, F.col("props")).alias("value"))


LOG_SQL = """log AS (SELECT CAST(user_id AS VARCHAR) AS user_key, event_id + 1 AS seq, event_type = 'error' AS tombstone,
  CASE WHEN event_type <> 'error' THEN props END AS value FROM events)"""


def visible_sql(where: str = "TRUE", log: str = "log") -> str:
    return f"""SELECT user_key AS key, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn
  FROM {log} WHERE {where}) WHERE rn = 1 AND NOT tombstone"""
