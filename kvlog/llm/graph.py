"""Connected components of an edge list, distributed, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (id, component): the smallest id reachable, for every id on an edge.

    Alternating large-star and small-star steps.  Both aggregate the smallest neighbour first, so a node with a
    third of all edges costs one partial row a task; its edges then meet that one row in an equi-join that adaptive
    execution may split.  The number of rounds is logarithmic for all known inputs; nothing is collected but a count.
    """
    most = edges.count()
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc", most)
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", 2 * most)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, most = now, now[0]
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
