"""What a log looks like at a sequence number.

All functions are DataFrame to DataFrame over columns user_key, seq, tombstone, value; key and value may have any
type that Spark orders.  The order of clauses is part of the meaning: ``seq <= at`` comes before the newest version
is picked, tombstones go after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Corruption, check_range

#: Keys up to this number are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def in_range(df: DataFrame, begin=None, end=None, key: str = "user_key") -> DataFrame:
    """Rows with begin <= key < end; None or an empty end means no bound.  Both bounds reach the Parquet scan."""
    if isinstance(begin, (bytes, str)) and isinstance(end, (bytes, str)):
        check_range(begin, end)
    if begin:
        df = df.where(F.col(key) >= F.lit(begin))
    return df.where(F.col(key) < F.lit(end)) if end else df


def newest(log: DataFrame, at: int | None = None, form: str = "rank") -> DataFrame:
    """The newest version of each key with ``seq <= at``, tombstones included.

    ``rank`` numbers versions in a window whose group limit drops all but the first of a task before the shuffle;
    ``hash`` aggregates max(seq) in hash maps and joins it back, which reads the log twice and pays for few hot keys.
    """
    log = log if at is None else log.where(F.col("seq") <= at)
    if form == "hash":
        top = log.groupBy("user_key").agg(F.max("seq").alias("seq"))
        return log.join(top, ["user_key", "seq"], "left_semi")
    order = Window.partitionBy("user_key").orderBy(F.desc("seq"))
    return log.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")


def visible(log: DataFrame, at: int | None = None, begin=None, end=None, form: str = "rank") -> DataFrame:
    """(key, value) of live keys at sequence ``at`` (None: latest) in [begin, end)."""
    live = newest(in_range(log, begin, end), at, form).where(~F.col("tombstone"))
    return live.select(F.col("user_key").alias("key"), "value")


def scan(log: DataFrame, begin=None, end=None, at: int | None = None) -> DataFrame:
    return visible(log, at, begin, end).orderBy("key")


def page(log: DataFrame, start, n: int, at: int | None = None, begin=None, end=None) -> DataFrame:
    """The first n live entries from max(start, begin): a seek and n steps of a cursor, as one top-n."""
    first = max(start, begin) if begin is not None else start
    return visible(log, at, first, end).orderBy("key").limit(n)


def get(log: DataFrame, key, at: int | None = None) -> DataFrame:
    """One row, or none if the key is missing or deleted; the key equality reaches the Parquet scan."""
    return visible(log.where(F.col("user_key") == F.lit(key)), at)


def multi_get(log: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """(key, value) of live keys among ``keys`` (key).  Keys are broadcast only while a count shows them few."""
    wanted = keys.select(F.col("key").alias("user_key")).distinct()
    few = wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return visible(log.join(F.broadcast(wanted) if few else wanted, "user_key", "left_semi"), at)


def history(log: DataFrame, key=None) -> DataFrame:
    """All versions in the internal order (key ascending, seq descending)."""
    log = log if key is None else log.where(F.col("user_key") == F.lit(key))
    return log.orderBy("user_key", F.desc("seq"))


def merge(runs: list[DataFrame]) -> DataFrame:
    """All versions of several runs in the internal order."""
    return history(reduce(lambda a, b: a.unionByName(b), runs))


def duplicates(log: DataFrame, key: tuple[str, ...] = ("user_key", "seq")) -> DataFrame:
    """(key, n) of versions that occur more than once; a sound log has none."""
    return log.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(log: DataFrame) -> DataFrame:
    if not duplicates(log).isEmpty():
        raise Corruption("a (key, sequence) pair occurs more than once")
    return log


def applied(arrived: DataFrame, order: str) -> DataFrame:
    """Entries with ``applied``: whether the sequence exceeds all that arrived for the key before (by ``order``)."""
    before = Window.partitionBy("user_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return arrived.withColumn("applied", F.coalesce(F.col("seq") > F.max("seq").over(before), F.lit(True)))


def sequence_faults(log: DataFrame, floor: int | Column = 0) -> DataFrame:
    """(seq, fault) of sequences that do not exceed the floor or repeat; gaps are no fault."""
    per = log.groupBy("seq").agg(F.count("*").alias("n"))
    fault = F.when(F.col("seq") <= floor, F.lit("floor")).when(F.col("n") > 1, F.lit("repeat"))
    return per.select("seq", fault.alias("fault")).where("fault is not null")


def difference(log: DataFrame, old: int, new: int) -> DataFrame:
    """(key, change, old_value, new_value) between two snapshots, in one pass over the versions."""
    log = log.where(F.col("seq") <= max(old, new))
    side = lambda s: F.max_by(F.when(F.col("seq") <= s, F.struct("tombstone", "value")), F.when(F.col("seq") <= s, F.col("seq")))
    both = log.groupBy("user_key").agg(side(old).alias("o"), side(new).alias("n"))
    live = lambda c: F.coalesce(~F.col(f"{c}.tombstone"), F.lit(False))
    o, n = live("o"), live("n")
    ov, nv = F.when(o, F.col("o.value")), F.when(n, F.col("n.value"))
    change = F.when(o & ~n, F.lit("deleted")).when(~o & n, F.lit("added")).when(o & n & ~ov.eqNullSafe(nv), F.lit("changed"))
    return both.select(F.col("user_key").alias("key"), change.alias("change"), ov.alias("old_value"), nv.alias("new_value")).where("change is not null")
