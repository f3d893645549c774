"""Driver queries over the test tables, each with the SQL that DuckDB runs beside it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cli import base64_column
from ..functions import folds, metrics
from ..operators import retention, runs, visibility
from ..sources.files import work_dir
from ..sources.store import Store
from ..streaming.ingest import ingest
from . import store_queries
from .base import LOG_SQL, Query, events_log, visible_sql

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None, log: bool = True) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = f"WITH {LOG_SQL} {sql}" if log and not sql.lstrip().startswith(",") else f"WITH {LOG_SQL}{sql}" if log else sql


def _on_log(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda spark, d: f(events_log(spark, d)), sql)


S, W = 5000, 6000
# Visibility and reads
_on_log("vis01_asof_view", lambda log: visibility.visible(log, S), visible_sql(f"seq <= {S}"))
_on_log("vis01_asof_view_hash", lambda log: visibility.visible(log, S, form="hash"), visible_sql(f"seq <= {S}"))
_on_log("vis02_latest_view", visibility.visible, visible_sql())
_on_log("vis03_key_history", lambda log: visibility.history(log, "42"), "SELECT * FROM log WHERE user_key = '42'")
_on_log("get01_hit", lambda log: visibility.get(log, "42"), visible_sql("user_key = '42'"))
_on_log("get02_at_snapshot", lambda log: visibility.get(log, "7", 800), visible_sql("user_key = '7' AND seq <= 800"))
_on_log("get01_missing", lambda log: visibility.get(log, "no such key"), visible_sql("user_key = 'no such key'"))
_on_log("get03_tombstone", lambda log: visibility.newest(log).where("tombstone").select("user_key", "seq"), "SELECT user_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND tombstone")
_on_log("scn01_range_scan", lambda log: visibility.scan(log, "2", "5"), visible_sql("user_key >= '2' AND user_key < '5'"))
_on_log("scn01_range_unbounded", lambda log: visibility.scan(log, "7", ""), visible_sql("user_key >= '7'"))
_on_log("scn02_cursor_at", lambda log: visibility.scan(log, "1", "3", 4000), visible_sql("user_key >= '1' AND user_key < '3' AND seq <= 4000"))
_on_log("scn03_seek", lambda log: visibility.visible(log, None, max("35", "2"), "5"), visible_sql("user_key >= '35' AND user_key < '5'"))
_on_log("scn06_page", lambda log: visibility.page(log, "35", 20), visible_sql("user_key >= '35'") + " ORDER BY key LIMIT 20")
_on_log("snp_difference", lambda log: visibility.difference(log, 5000, 9000), f""", o AS ({visible_sql("seq <= 5000")}), n AS ({visible_sql("seq <= 9000")})
SELECT coalesce(o.key, n.key) AS key, CASE WHEN n.key IS NULL THEN 'deleted' WHEN o.key IS NULL THEN 'added' ELSE 'changed' END AS change,
  o.value AS old_value, n.value AS new_value FROM o FULL JOIN n ON o.key = n.key WHERE o.key IS NULL OR n.key IS NULL OR o.value IS DISTINCT FROM n.value""")
_add(
    "get08_multi_get",
    lambda spark, d: visibility.multi_get(events_log(spark, d), spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))),
    visible_sql("user_key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)"),
)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a log: one key a customer; order keys are unique, and so serve as sequences."""
    gone = F.col("o_orderstatus") == "F"
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("user_key"), (F.col("o_orderkey") + 1).alias("seq"), gone.alias("tombstone"), F.when(~gone, F.col("o_totalprice")).alias("value"))


ORDERS_SQL = """, o AS (SELECT CAST(o_custkey AS VARCHAR) AS user_key, o_orderkey + 1 AS seq, o_orderstatus = 'F' AS tombstone,
  CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value FROM orders)"""
_add("vis02_orders_latest", lambda spark, d: visibility.visible(orders_log(spark, d)), f"{ORDERS_SQL} {visible_sql(log='o')}")
_add("vis02_conversations_latest", lambda spark, d: visibility.visible(spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").cast("string").alias("user_key"), F.col("turn").alias("seq"), F.lit(False).alias("tombstone"), F.col("text").alias("value"))), "SELECT CAST(conv_id AS VARCHAR) AS key, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")


def _slices(log: DataFrame, n: int) -> list[DataFrame]:
    """The whole log as n runs of equal sequence ranges, oldest first; only its greatest sequence reaches the driver."""
    top = log.agg(F.max("seq")).first()[0] or 0
    bounds = [-(-i * top // n) for i in range(n + 1)]
    return [log.where(f"seq > {low} and seq <= {high}") for low, high in zip(bounds, bounds[1:])]


def _after_prefix(log: DataFrame, n: int = 8, trigger: int = 4) -> DataFrame:
    """The whole log after the oldest ``trigger`` of its n runs became run 0; newer runs keep their numbers."""
    found = _slices(log, n)
    merged = [visibility.merge(found[:trigger]).withColumn("run_no", F.lit(0))]
    return reduce(DataFrame.unionByName, merged + [r.withColumn("run_no", F.lit(i)) for i, r in enumerate(found) if i >= trigger])


# Merge and integrity
_on_log("mrg01_merged_history", lambda log: visibility.merge(_slices(log, 4)), "SELECT * FROM log")
_add("mrg02_duplicate_versions", lambda spark, d: visibility.duplicates(spark.read.parquet(f"{d}/lineitem.parquet"), ("l_orderkey", "l_linenumber")), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", log=False)
_on_log("wal_sequence_faults", lambda log: visibility.sequence_faults(log.select((F.col("seq") - F.col("seq") % 7).alias("seq")), 70), "SELECT seq, CASE WHEN seq <= 70 THEN 'floor' ELSE 'repeat' END AS fault FROM (SELECT seq - seq % 7 AS seq FROM log) GROUP BY seq HAVING seq <= 70 OR count(*) > 1")
_on_log("wrt04_batch_validation", lambda log: log.groupBy((F.floor((F.col("seq") - 1) / 500)).cast("long").alias("batch")).agg(F.count("*").alias("operations"), F.max(F.octet_length("user_key")).cast("long").alias("longest_key"), F.max(F.octet_length("value")).cast("long").alias("longest_value"), F.sum((F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")).alias("bytes")), "SELECT (seq - 1) // 500 AS batch, count(*) AS operations, CAST(max(strlen(user_key)) AS BIGINT) AS longest_key, CAST(max(strlen(value)) AS BIGINT) AS longest_value, CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM log GROUP BY ALL")
_on_log("wrt10_version_steps", lambda log: log.groupBy("user_key").agg(F.count("*").alias("versions"), F.count_distinct("seq").alias("sequences"), F.max("seq").alias("newest")), "SELECT user_key, count(*) AS versions, count(DISTINCT seq) AS sequences, max(seq) AS newest FROM log GROUP BY user_key")

# Retention
_GC = f"SELECT user_key, seq, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key, seq <= {W} ORDER BY seq DESC) AS r FROM log) WHERE seq > {W} OR r = 1"
_on_log("cmp03_partial_prefix", _after_prefix, "SELECT log.*, CAST(CASE WHEN (seq - 1) * 8 // m < 4 THEN 0 ELSE (seq - 1) * 8 // m END AS INTEGER) AS run_no FROM log, (SELECT max(seq) AS m FROM log)")
_on_log("cmp04_gc_no_snapshot", retention.compact, "SELECT user_key, seq, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT tombstone")
_on_log("cmp05_gc_watermark", lambda log: retention.compact(log, W), _GC)
_on_log("cmp06_retained", lambda log: retention.retained(log, W), f"SELECT count(*) AS versions, CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM ({_GC})")
_on_log("cmp05_view_after_gc", lambda log: visibility.visible(retention.compact(log, W), 8000), visible_sql("seq <= 8000"))


# Runs
def _runs(log: DataFrame) -> DataFrame:
    described = runs.describe(log.withColumn("run_no", F.floor((F.col("seq") - 1) / 1000).cast("long")))
    return described.select(F.col("run_no").alias("position"), (F.col("entries") * 100).alias("file_size"), "smallest_key", "largest_key", "min_sequence", "max_sequence")


_RUNS_SQL = """, runs AS (SELECT (seq - 1) // 1000 AS position, count(*) * 100 AS file_size, min(user_key) AS smallest_key, max(user_key) AS largest_key,
  min(seq) AS min_sequence, max(seq) AS max_sequence FROM log GROUP BY 1)"""
_on_log("src06_run_meta", _runs, f"{_RUNS_SQL} SELECT * FROM runs")
_on_log("snk04_run_order_check", lambda log: runs.order_faults(_runs(log).withColumn("min_sequence", F.when(F.col("position") == 3, F.lit(2500)).otherwise(F.col("min_sequence")))), f"{_RUNS_SQL}, r AS (SELECT * REPLACE (CASE WHEN position = 3 THEN 2500 ELSE min_sequence END AS min_sequence) FROM runs), l AS (SELECT *, lag(max_sequence) OVER (ORDER BY position) AS p FROM r) SELECT * EXCLUDE p FROM l WHERE min_sequence <= p OR min_sequence < 1 OR min_sequence > max_sequence")
_on_log("scn05_runs_overlapping", lambda log: runs.overlapping(_runs(log), "2", "5", 4200), f"{_RUNS_SQL} SELECT * FROM runs WHERE largest_key >= '2' AND smallest_key < '5' AND min_sequence <= 4200")
_on_log("cmp02_compaction_pick", lambda log: runs.pick(_runs(log), 4), f"{_RUNS_SQL} SELECT * FROM runs WHERE (SELECT count(*) FROM runs) >= 4 ORDER BY position LIMIT 4")
_on_log("cmp09_debt_gauges", lambda log: runs.gauges(_runs(log), 4), f"{_RUNS_SQL} SELECT count(*) AS live_tables, CAST(sum(file_size) AS BIGINT) AS live_bytes, CASE WHEN count(*) >= 4 THEN count(*) - 3 ELSE 0 END AS debt_tables, CAST(CASE WHEN count(*) >= 4 THEN sum(CASE WHEN position < 4 THEN file_size ELSE 0 END) ELSE 0 END AS BIGINT) AS debt_bytes FROM runs")

# Metrics
_on_log("met05_read_amplification", lambda log: metrics.read_amplification(log.select(F.col("user_key").alias("key")), _runs(log)), f"{_RUNS_SQL}, p AS (SELECT count(*) AS n FROM log l JOIN runs r ON l.user_key BETWEEN r.smallest_key AND r.largest_key) SELECT p.n AS table_probes, (SELECT count(*) FROM log) AS point_lookups, p.n / CAST((SELECT count(*) FROM log) AS DOUBLE) AS read_amplification FROM p")


def _amplification(log: DataFrame) -> DataFrame:
    size = F.octet_length("user_key") + F.coalesce(F.octet_length("value"), F.lit(0))
    written = log.agg(F.sum(size).alias("logical"))
    kept = retention.retained(log)
    return written.crossJoin(kept).select(F.col("logical").alias("logical_bytes"), F.col("bytes").alias("live_bytes"), metrics.ratio(F.col("logical") + F.col("bytes"), F.col("logical")).alias("write_amplification"), metrics.ratio(F.col("logical"), F.col("bytes")).alias("space_amplification"))


_on_log("met06_met07_amplification", _amplification, """, w AS (SELECT CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS l FROM log),
k AS (SELECT CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS b FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT tombstone)
SELECT l AS logical_bytes, b AS live_bytes, (l + b) / CAST(l AS DOUBLE) AS write_amplification, l / CAST(b AS DOUBLE) AS space_amplification FROM w, k""")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _both_ways(live: DataFrame, model: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks."""
    return live.exceptAll(model).unionByName(model.exceptAll(live))


_PICK = "list_extract(list_sort(list(value)), CAST(ceil({} * (count(value) - 1)) AS BIGINT) + 1) AS {}"
_add("met08_latency_percentiles", lambda spark, d: metrics.latency(_events(spark, d), "value", ["event_type"]), "SELECT event_type, count(value) AS operations, " + ", ".join(_PICK.format(p, n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM events WHERE value IS NOT NULL GROUP BY event_type", log=False)
_add("met09_ops_per_window", lambda spark, d: _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), F.col("event_type").alias("kind")).agg(F.count("*").alias("operations"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "operations", F.round("total", 4).alias("total")), "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS kind, count(*) AS operations, round(sum(value), 4) AS total FROM events GROUP BY ALL", log=False)
_add("met10_op_counts", lambda spark, d: metrics.operation_counts(_events(spark, d), "event_type", F.col("value") > 50), "SELECT event_type AS kind, count(*) AS operations, count(*) FILTER (WHERE value > 50) AS errors FROM events GROUP BY 1", log=False)
_add("met12_live_vs_model", lambda spark, d: _both_ways(visibility.visible(events_log(spark, d)), visibility.visible(events_log(spark, d), form="hash")), "SELECT user_key AS key, value FROM log WHERE FALSE")
_add("met15_event_page", lambda spark, d: _events(spark, d).where("event_id < 5000").orderBy(F.desc("event_id")).limit(101).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_id < 5000 ORDER BY event_id DESC LIMIT 101", log=False)
_add("met20_stability_gate", lambda spark, d: metrics.stability(*[_events(spark, d).where(f"event_id % 2 = {k}").groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("value")) for k in (0, 1)]), """, a AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1), j AS (SELECT coalesce(a.name, b.name) AS name, a, b, CASE WHEN (a + b) / 2 = 0 THEN 0 ELSE abs(a - b) / sqrt(2) / ((a + b) / 2) * 100 END AS cv_percent FROM a FULL JOIN b ON a.name = b.name)
SELECT name, a, b, cv_percent, coalesce(cv_percent <= 10, FALSE) AS ok FROM j""")
_on_log("cli02_json_export", lambda log: visibility.visible(log).select(F.to_json(F.struct(base64_column(F.col("key").cast("binary")).alias("key_base64"), base64_column(F.col("value").cast("binary")).alias("value_base64"))).alias("line")), f"SELECT '{{\"key_base64\":\"' || to_base64(encode(key)) || '\",\"value_base64\":\"' || to_base64(encode(value)) || '\"}}' AS line FROM ({visible_sql()})")


# Ordered folds: the store is the event type
def _fold(name: str, fold, columns: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _events(spark, d).select(F.col("event_type").alias("store"), F.col("event_id").alias("n"), F.octet_length("props").cast("long").alias("size"), (F.floor(F.col("event_id") / 8)).cast("long").alias("grp"))
        return folds.assign(df, "store", ["n"], columns, fold, name)

    return run


_FOLD_SQL = """WITH RECURSIVE e AS (SELECT event_type AS store, event_id AS n, CAST(strlen(props) AS BIGINT) AS size, event_id // 8 AS grp,
  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
f(store, i, {names}) AS (SELECT store, i, {first} FROM e WHERE i = 1
  UNION ALL SELECT e.store, e.i, {next} FROM f JOIN e ON e.store = f.store AND e.i = f.i + 1)
SELECT e.store, e.n, e.size, e.grp, CAST(f.{out} AS BIGINT) AS {out} FROM f JOIN e USING (store, i)"""
_add("wrt07_group_packing", _fold("group_no", lambda: folds.GroupPacker(8, 200), ["size"]), _FOLD_SQL.format(first="0 AS group_no, 1 AS c, size AS h", next="CASE WHEN {cut} THEN f.group_no + 1 ELSE f.group_no END, CASE WHEN {cut} THEN 1 ELSE f.c + 1 END, CASE WHEN {cut} THEN e.size ELSE f.h + e.size END".format(cut="(f.c >= 8 OR f.h + greatest(e.size, 1) > 200)"), names="group_no, c, h", out="group_no"), log=False)
_add("wrt12_rotation", _fold("generation", lambda: folds.Rotation(5000), ["size", "grp"]), _FOLD_SQL.format(first="0 AS generation, size AS h, grp AS lastg", next="CASE WHEN {cut} THEN f.generation + 1 ELSE f.generation END, CASE WHEN {cut} THEN e.size ELSE f.h + e.size END, e.grp".format(cut="(e.grp <> f.lastg AND f.h >= 5000)"), names="generation, h, lastg", out="generation"), log=False)
_add("snk01_block_cut", _fold("block_no", lambda: folds.BlockCutter(4096), ["grp", "size"]), _FOLD_SQL.format(first="0 AS block_no, 21 + strlen(CAST(grp AS VARCHAR)) + size AS h, 1 AS c, grp AS lastk", next="CASE WHEN {cut} THEN f.block_no + 1 ELSE f.block_no END, CASE WHEN {cut} THEN {own} ELSE f.h + {own} END, CASE WHEN {cut} THEN 1 ELSE f.c + 1 END, e.grp".format(cut="(e.grp <> f.lastk AND f.h + 21 + strlen(CAST(e.grp AS VARCHAR)) + e.size + (f.c + 1) * 4 + 8 > 4096)", own="(21 + strlen(CAST(e.grp AS VARCHAR)) + e.size)"), names="block_no, h, c, lastk", out="block_no"), log=False)


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a stream, each micro-batch one commit of a store; its latest view when the input is used up."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    gone = F.col("event_type") == "error"
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    op = F.when(gone, F.lit("delete")).otherwise(F.lit("put"))
    value = F.when(~gone, F.coalesce("props", F.lit(""))).cast("binary")
    feed = feed.select(F.col("event_id").alias("ordinal"), op.alias("op"), F.col("user_id").cast("string").cast("binary").alias("key"), value.alias("value"))
    folder = work_dir(spark)
    with Store.open(spark, f"{folder}/store") as store:
        q = ingest(feed, store, f"{folder}/checkpoint", "events")
        try:
            q.awaitTermination(600)
        finally:
            q.stop()
        return store.scan().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


_add("stream_latest_view", _stream_latest, visible_sql())


def queries() -> dict[str, Query]:
    return _QUERIES | store_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | store_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["vis02_latest_view"](spark, sf_dir)


