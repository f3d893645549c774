"""Metrics over operations, runs and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile(values: Column, p: float) -> Column:
    """Of a sorted array: the element at index ceil(p * (n - 1)); 0 if it is empty."""
    n = F.size(values)
    return F.when(n == 0, F.lit(0)).otherwise(F.get(values, F.ceil(F.lit(p) * (n - 1)).cast("int")))


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95, p99 a group by the exact rule of ``percentile``.

    Values are counted first, so a group costs one row for each distinct value, not one for each operation.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*by)
    counts = counts.withColumns({"upto": F.sum("c").over(whole.orderBy("x")), "n": F.sum("c").over(whole)})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.lit(p) * (F.col("n") - 1)) + 1, F.col("x")))
    return counts.groupBy(*by).agg(F.first("n").alias("operations"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def points(ops: DataFrame, ts: str, order: str, value: str, samples: int = 4096, most: int = 600) -> DataFrame:
    """The newest ``most`` seconds with operations: at, operations, and p50, p95, p99 of the last ``samples`` values
    as of the end of each second.

    No second needs more than its own last ``samples`` values, so what is laid out in one order is bounded by
    (most + 1) * samples values, whatever the input.
    """
    rows = ops.where(F.col(value).isNotNull()).select(F.date_trunc("second", ts).alias("at"), F.struct(F.col(ts).alias("t"), F.col(order).alias("o")).alias("k"), F.col(value).alias("x"))
    newest = rows.groupBy("at").agg(F.count("*").alias("operations")).orderBy(F.desc("at")).limit(most)
    first = newest.agg(F.min("at")).first()[0]
    late = rows.where(F.col("at") >= F.lit(first)).withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("k")))).where(F.col("r") <= samples).drop("r")
    early = rows.where(F.col("at") < F.lit(first)).orderBy(F.desc("k")).limit(samples)
    kept = late.unionByName(early)
    line = kept.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("line"), F.lit(1).alias("one"))
    ends = kept.groupBy("at").agg(F.count("*").alias("n")).withColumn("last", F.sum("n").over(Window.orderBy("at")))
    out = newest.join(ends, "at").withColumn("one", F.lit(1)).join(line, "one")
    start = F.greatest(F.lit(0), F.col("last") - samples)
    window = F.sort_array(F.slice("line", (start + 1).cast("int"), (F.col("last") - start).cast("int")))
    out = out.withColumn("w", window)
    return out.select("at", "operations", *[percentile(F.col("w"), p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


def operation_counts(ops: DataFrame, kind: str, failed: Column) -> DataFrame:
    return ops.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("operations"), F.count_if(failed).alias("errors"))


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top.cast("double") / bottom)


def read_amplification(lookups: DataFrame, runs: DataFrame) -> DataFrame:
    """Table probes a point lookup: runs whose key range holds the key.  Run metadata is a few rows, broadcast; the
    number of runs is kept small by compaction and is checked."""
    few = runs.select("smallest_key", "largest_key")
    if few.limit(10_001).count() <= 10_000:
        few = F.broadcast(few)
    keys = lookups.groupBy("key").agg(F.count("*").alias("n"))
    hits = keys.join(few, (F.col("key") >= F.col("smallest_key")) & (F.col("key") <= F.col("largest_key")), "left")
    probes = hits.groupBy("key").agg(F.first("n").alias("n"), F.count("smallest_key").alias("p"))
    total = probes.agg(F.coalesce(F.sum(F.col("n") * F.col("p")), F.lit(0)).alias("table_probes"), F.coalesce(F.sum("n"), F.lit(0)).alias("point_lookups"))
    return total.withColumn("read_amplification", ratio(F.col("table_probes"), F.col("point_lookups")))


def stability(first: DataFrame, second: DataFrame, limit: float = 10.0) -> DataFrame:
    """Benchmark cases (name, value) of two runs: spread in percent, and whether each case is in both and steady."""
    a, b = F.col("a"), F.col("b")
    both = first.select("name", F.col("value").alias("a")).join(second.select("name", F.col("value").alias("b")), "name", "full")
    mean = (a + b) / 2
    cv = F.when(mean == 0, F.lit(0.0)).otherwise(F.abs(a - b) / F.sqrt(F.lit(2.0)) / mean * 100)
    return both.withColumn("cv_percent", cv).withColumn("ok", F.coalesce(cv <= limit, F.lit(False)))
