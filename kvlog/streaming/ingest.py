"""Structured Streaming over change feeds.

A version with an old sequence can never win, so late rows are harmless and latest-view state needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def latest(feed: DataFrame) -> DataFrame:
    """Newest version of each key of a streaming log; write it in complete or update mode."""
    return feed.groupBy("user_key").agg(F.max_by(F.struct("seq", "tombstone", "value"), "seq").alias("n")).select("user_key", "n.seq", "n.tombstone", "n.value")


def live_view(feed: DataFrame) -> DataFrame:
    return latest(feed).where(~F.col("tombstone")).select(F.col("user_key").alias("key"), "value")


def windowed_counts(ops: DataFrame, ts: str, kind: str, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Operations a window and kind, for a batch or a stream with late rows."""
    ops = ops.withWatermark(ts, late) if ops.isStreaming else ops
    return ops.groupBy(F.window(ts, width), F.col(kind).alias("kind")).agg(F.count("*").alias("operations"))


def ingest(feed: DataFrame, store: Store, checkpoint: str, query_id: str) -> StreamingQuery:
    """Each micro-batch of a mutation stream becomes one commit; a repeated batch is recognised by its id."""

    def commit(batch: DataFrame, number: int) -> None:
        store.write_frame(batch, f"{query_id}/{number}")

    return feed.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
