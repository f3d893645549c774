"""Run metadata: order, pruning, size-tiered picks and gauges, over DataFrames like ``model.RUNS``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def describe(log: DataFrame, run: str = "run_no") -> DataFrame:
    """Count, key range and sequence range of each run."""
    return log.groupBy(run).agg(F.count("*").alias("entries"), F.min("user_key").alias("smallest_key"), F.max("user_key").alias("largest_key"), F.min("seq").alias("min_sequence"), F.max("seq").alias("max_sequence"))


def order_faults(runs: DataFrame) -> DataFrame:
    """Runs (oldest first by position) whose sequences do not follow those of the run before."""
    w = Window.orderBy("position")  # metadata only: a few rows a run
    prev = F.lag("max_sequence").over(w)
    bad = (F.col("min_sequence") < 1) | (F.col("min_sequence") > F.col("max_sequence")) | F.coalesce(F.col("min_sequence") <= prev, F.lit(False))
    return runs.withColumn("__bad", bad).where("__bad").drop("__bad")


def overlapping(runs: DataFrame, begin=None, end=None, at: int | None = None) -> DataFrame:
    """Runs that a read of [begin, end) at ``at`` has to open."""
    if begin:
        runs = runs.where(F.col("largest_key") >= F.lit(begin))
    if end:
        runs = runs.where(F.col("smallest_key") < F.lit(end))
    return runs if at is None else runs.where(F.col("min_sequence") <= at)


def pick(runs: DataFrame, trigger: int = 4) -> DataFrame:
    """The oldest ``trigger`` runs, if there are that many; otherwise none."""
    if not trigger:
        return runs.limit(0)
    w = Window.orderBy("position")
    counted = runs.withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy()))
    return counted.where((F.col("__n") >= trigger) & (F.col("__r") <= trigger)).drop("__r", "__n")


def gauges(runs: DataFrame, trigger: int = 4) -> DataFrame:
    """One row: live tables and bytes, and the debt in tables and bytes of merges that are due."""
    w = Window.orderBy("position")
    r = runs.withColumn("__r", F.row_number().over(w))
    n = F.count("*")
    due = F.when((n >= trigger) & F.lit(bool(trigger)), n - trigger + 1).otherwise(0)
    size = F.sum(F.when(F.col("__r") <= trigger, F.col("file_size")).otherwise(0))
    return r.agg(n.alias("live_tables"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("live_bytes"), due.cast("long").alias("debt_tables"), F.when(due > 0, size).otherwise(0).cast("long").alias("debt_bytes"))
