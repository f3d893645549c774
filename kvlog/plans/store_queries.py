"""Driver queries over the store, the binary formats and replayed workloads, each with its DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, metrics, workload
from ..functions.session import Session
from ..model import Options
from ..operators import retention, visibility
from ..sources import wal
from ..sources.files import work_dir
from ..sources.store import Snapshot, Store
from ..sources.writer import Writer
from .base import LOG_SQL, Query, events_log, visible_sql

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _log(sql: str, more: str = "") -> str:
    return f"WITH {LOG_SQL}{more} {sql}"


# The store
_HALF = "(SELECT max(seq) // 2 FROM log)"


def _filled(spark: SparkSession, sf_dir: str) -> tuple[Store, Snapshot]:
    """A store that took events in two commits, with a snapshot between them."""
    log = events_log(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    store = Store.open(spark, work_dir(spark), Options(compaction_table_trigger=0))
    kind = F.when(F.col("tombstone"), F.lit("delete")).otherwise(F.lit("put"))
    frame = log.select(F.col("seq").alias("ordinal"), kind.alias("op"), F.col("user_key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    store.write_frame(frame.where(f"ordinal <= {half}"), "first")
    snapshot = store.snapshot()
    store.write_frame(frame.where(f"ordinal > {half}"), "second")
    store.write_frame(frame, "second")  # known already, and so skipped
    return store, snapshot


def _texts(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if c in ("key", "user_key", "value") else c for c in df.columns])


@_query("store_roundtrip", _log(visible_sql()))
def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, closed, opened again and checked against its manifest: the latest view."""
    store, _ = _filled(spark, sf_dir)
    store.close()
    with Store.open(spark, store.files.root, Options(compaction_table_trigger=0, validate_on_open=True)) as again:
        return _texts(again.scan())


@_query("store_snapshot_view", _log(visible_sql(f"seq <= {_HALF}")))
def store_snapshot_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of a snapshot, read after later writes and a compaction."""
    store, snapshot = _filled(spark, sf_dir)
    with store:
        store.compact()
        return _texts(store.scan(snapshot=snapshot))


@_query("store_compaction", _log(f"SELECT user_key, seq, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key, seq <= {_HALF} ORDER BY seq DESC) AS r FROM log) WHERE seq > {_HALF} OR r = 1"))
def store_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions that a full compaction keeps while a snapshot is held."""
    store, _ = _filled(spark, sf_dir)
    with store:
        store.compact()
        return _texts(store.log())


@_query("store_multi_get", _log(visible_sql("user_key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")))
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").cast("binary").alias("key"))
    store, _ = _filled(spark, sf_dir)
    with store:
        return _texts(store.multi_get(keys))


@_query("store_range_scan", _log(visible_sql("user_key >= '2' AND user_key < '5'")))
def store_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _filled(spark, sf_dir)
    with store:
        return _texts(store.scan(b"2", b"5"))


_SIZE = "strlen(user_key) + coalesce(strlen(value), 0)"


@_query(
    "store_counters",
    _log(
        f"""SELECT 'operations' AS name, count(*) AS n FROM log UNION ALL SELECT 'last_sequence', max(seq) FROM log
UNION ALL SELECT 'logical_write_bytes', CAST(sum({_SIZE}) AS BIGINT) FROM log UNION ALL SELECT 'retained_versions', count(*) FROM kept
UNION ALL SELECT 'retained_bytes', CAST(sum({_SIZE}) AS BIGINT) FROM kept UNION ALL SELECT 'live_entries', count(*) FROM kept
UNION ALL SELECT * FROM (VALUES ('live_tables', 1), ('debt_tables', 0), ('compactions', 1), ('active_snapshots', 0))""",
        ", kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1 AND NOT tombstone)",
    ),
)
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, snapshot = _filled(spark, sf_dir)
    with store:
        store.release(snapshot)
        store.compact()
        found = store.all_metrics()
        names = ("operations", "last_sequence", "logical_write_bytes", "retained_versions", "retained_bytes", "live_entries", "live_tables", "debt_tables", "compactions", "active_snapshots")
        return spark.createDataFrame([(n, found[n]) for n in names], "name string, n long")


@_query("met17_files_by_kind", "SELECT * FROM (VALUES ('manifest', 'live', 1), ('manifest', 'old', 3), ('run', 'live', 1), ('run', 'orphan', 2)) AS t(kind, state, files)")
def met17_files_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a store after two commits and a compaction: the merged runs are orphans until the next vacuum."""
    store, _ = _filled(spark, sf_dir)
    with store:
        store.compact()
        return store.bytes_by_kind().select("kind", "state", F.col("files").cast("long").alias("files"))


@_query("snk05_after_vacuum", "SELECT * FROM (VALUES ('manifest', 'live', 1), ('run', 'live', 1)) AS t(kind, state, files)")
def snk05_after_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _filled(spark, sf_dir)
    with store:
        store.compact()
        store.vacuum(1)
        return store.bytes_by_kind().select("kind", "state", F.col("files").cast("long").alias("files"))


# Binary formats
def _wal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log files (path, content) of 500 sequences, in batch records of 50."""
    log = events_log(spark, sf_dir).withColumn("file", F.floor((F.col("seq") - 1) / 500).cast("long"))

    def encode(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["seq", "user_key", "tombstone", "value"]).to_pylist(), key=lambda r: r["seq"])
        found = [formats.Entry(r["user_key"].encode(), r["seq"], r["tombstone"], (r["value"] or "").encode()) for r in rows]
        content = b"".join(formats.encode_batch(found[i : i + 50]) for i in range(0, len(found), 50))
        return pa.table({"path": [f"{key[0].as_py() + 1:06d}.wal"], "content": pa.array([content], pa.binary())})

    return log.groupBy("file").applyInArrow(encode, "path string, content binary")


@_query("src07_wal_decode", _log("SELECT printf('%06d.wal', (seq - 1) // 500 + 1) AS file, (seq - 1) % 500 // 50 AS record, user_key, seq, tombstone, value FROM log"))
def src07_wal_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(wal.decode_wal(_wal_files(spark, sf_dir)))


_FILES = ", f AS (SELECT (seq - 1) // 500 + 1 AS no, count(*) AS n, max(seq) AS top, min(seq) AS low FROM log GROUP BY 1)"


@_query(
    "met19_recovery",
    _log(
        """SELECT printf('%06d.wal', no) AS path, s AS scenario, CASE s WHEN 'unclean_shutdown' THEN n WHEN 'truncated_wal' THEN (n - 1) // 50 * 50 END AS entries,
CASE s WHEN 'unclean_shutdown' THEN top WHEN 'truncated_wal' THEN CASE WHEN n > 50 THEN low + (n - 1) // 50 * 50 - 1 END END AS max_sequence,
CASE s WHEN 'unclean_shutdown' THEN FALSE WHEN 'truncated_wal' THEN TRUE END AS truncated_tail, s = 'crc_corruption' AS corrupt
FROM f, (VALUES ('unclean_shutdown'), ('truncated_wal'), ('crc_corruption')) AS t(s)""",
        _FILES,
    ),
)
def met19_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recovery finds in log files as they are, without their last five bytes, and with a changed byte inside."""
    files = _wal_files(spark, sf_dir)
    size = F.octet_length("content")
    cut = F.substring("content", F.lit(1), size - 5)
    part = lambda first, n: F.substring("content", F.lit(first), n if not isinstance(n, int) else F.lit(n))
    flipped = F.concat(part(1, 30), F.when(part(31, 1) == F.lit(b"\0"), F.lit(b"\1")).otherwise(F.lit(b"\0")), part(32, size))
    found = None
    for name, content in (("unclean_shutdown", F.col("content")), ("truncated_wal", cut), ("crc_corruption", flipped)):
        case = wal.recover_wal(files.select("path", content.alias("content")))
        case = case.select("path", F.lit(name).alias("scenario"), "entries", "max_sequence", "truncated_tail", F.col("error").isNotNull().alias("corrupt"))
        found = case if found is None else found.unionByName(case)
    return found


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as table files, one for each of 16 key classes: (no, content)."""
    log = events_log(spark, sf_dir).withColumn("no", (F.col("user_key").cast("long") % 16).cast("long"))

    def encode(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [formats.Entry(r["user_key"].encode(), r["seq"], r["tombstone"], (r["value"] or "").encode()) for r in table.to_pylist()]
        content = formats.encode_table(sorted(found, key=lambda e: (e.key, -e.seq)), 4096)
        return pa.table({"no": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    return log.groupBy("no").applyInArrow(encode, "no long, content binary")


@_query("src03_table_scan", _log("SELECT CAST(user_key AS BIGINT) % 16 AS no, user_key, seq, tombstone, value FROM log"))
def src03_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of encoded table files, blocks, index, properties and footer decoded and checked."""
    schema = pa.schema([("no", pa.int64()), ("user_key", pa.binary()), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary())])

    def decode(batches):
        for batch in batches:
            for no, content in zip(batch.column("no").to_pylist(), batch.column("content").to_pylist()):
                found = formats.decode_table(content)[0]
                yield pa.RecordBatch.from_pylist([{"no": no, "user_key": e.key, "seq": e.seq, "tombstone": e.tombstone, "value": None if e.tombstone else e.value} for e in found], schema=schema)

    return _texts(_tables(spark, sf_dir).mapInArrow(decode, "no long, user_key binary, seq long, tombstone boolean, value binary"))


@_query("met18_table_inspection", _log("SELECT CAST(user_key AS BIGINT) % 16 AS no, count(*) AS entries, min(seq) AS min_sequence, max(seq) AS max_sequence, min(user_key) AS smallest_key, max(user_key) AS largest_key, TRUE AS blocks_cover FROM log GROUP BY 1"))
def met18_table_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of each table file, and whether its blocks lie end to end in key order."""
    schema = "no long, entries long, min_sequence long, max_sequence long, smallest_key binary, largest_key binary, blocks_cover boolean"

    def inspect(batches):
        for batch in batches:
            out = []
            for no, content in zip(batch.column("no").to_pylist(), batch.column("content").to_pylist()):
                found, refs, p = formats.decode_table(content)
                ends = [0] + [r.offset + r.size for r in refs]
                cover = all(r.offset == at for r, at in zip(refs, ends)) and all(a.last < b.first for a, b in zip(refs, refs[1:]))
                out.append((no, len(found), p.min_sequence, p.max_sequence, found[0].key, found[-1].key, cover))
            types = (pa.int64(),) * 4 + (pa.binary(),) * 2 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=[c.split()[0] for c in schema.split(", ")]) if out else pa.RecordBatch.from_pylist([])

    found = _tables(spark, sf_dir).mapInArrow(inspect, schema)
    return found.withColumns({c: F.col(c).cast("string") for c in ("smallest_key", "largest_key")})


@_query("get05_block_lookup", _log("SELECT user_key, seq, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM log WHERE seq <= 5000) WHERE rn = 1"))
def get05_block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of every key at a sequence, found inside the blocks of table files through their index."""
    schema = pa.schema([("user_key", pa.binary()), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary())])

    def look(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                found, refs, _ = formats.decode_table(content)
                rows = []
                for key in dict.fromkeys(e.key for e in found):
                    ref = next(r for r in refs if key <= r.last)
                    e = formats.find_in_block(formats.decode_block_v2(content[ref.offset : ref.offset + ref.size]), key, 5000)
                    if e is not None:
                        rows.append({"user_key": e.key, "seq": e.seq, "tombstone": e.tombstone, "value": None if e.tombstone else e.value})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _texts(_tables(spark, sf_dir).mapInArrow(look, "user_key binary, seq long, tombstone boolean, value binary"))


@_query("snk04_manifest_codec", _log("SELECT (seq - 1) // 1000 + 1 AS number, count(*) * 100 AS size, min(user_key) AS smallest_key, max(user_key) AS largest_key, min(seq) AS min_sequence, max(seq) AS max_sequence FROM log GROUP BY 1"))
def snk04_manifest_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run metadata through an encoded and decoded manifest; a row a run, checked to be few."""
    run = F.floor((F.col("seq") - 1) / 1000).cast("long") + 1
    rows = events_log(spark, sf_dir).groupBy(run.alias("number")).agg((F.count("*") * 100).alias("size"), F.min("user_key"), F.max("user_key"), F.min("seq"), F.max("seq")).orderBy("number").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("a manifest holds the metadata of few runs")
    tables = [formats.TableMeta(r[0], r[1], r[2].encode(), r[3].encode(), r[4], r[5]) for r in rows]
    last = max([t.max_sequence for t in tables], default=0)
    out = formats.decode_manifest(formats.encode_manifest(formats.Manifest(next_file_number=len(tables) + 2, last_sequence=last, live_tables=tables)))
    return spark.createDataFrame([(t.file_number, t.file_size, t.smallest_key.decode(), t.largest_key.decode(), t.min_sequence, t.max_sequence) for t in out.live_tables], "number long, size long, smallest_key string, largest_key string, min_sequence long, max_sequence long")


# Workloads
_WORK = workload.Workload(operation_count=900, seed=77, key_space=40, value_bytes=12)
_WORK_SQL = f"""WITH RECURSIVE draws(k, x) AS (SELECT 0, CAST(77 AS HUGEINT) UNION ALL
  SELECT k + 1, (x * {workload.LCG_MULTIPLIER} + {workload.LCG_INCREMENT}) % 18446744073709551616 FROM draws WHERE k < 2700),
o AS (SELECT a.k // 3 AS n, CASE WHEN a.x % 100 < 80 THEN b.x % 8 ELSE b.x % 40 END AS slot, c.x % 100 AS sel
  FROM draws a JOIN draws b ON b.k = a.k + 1 JOIN draws c ON c.k = a.k + 2 WHERE a.k % 3 = 1),
ops AS (SELECT CAST(n AS BIGINT) AS n, CASE WHEN sel < 50 THEN 'put' WHEN sel < 80 THEN 'get' ELSE 'delete' END AS kind, 'key-' || lpad(CAST(slot AS VARCHAR), 8, '0') AS key,
  CASE WHEN sel < 50 THEN rpad('value-' || n, 12, chr(CAST(97 + n % 26 AS INTEGER))) END AS value FROM o)"""


@_query("met13_workload", f"{_WORK_SQL} SELECT * FROM ops")
def met13_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations of a seeded hotspot workload."""
    rows = [(n, kind, key.decode(), None if value is None else value.decode()) for n, kind, key, value in workload.operations(_WORK)]
    return spark.createDataFrame(rows, "n long, kind string, key string, value string")


@_query("met12_replayed_model", f"{_WORK_SQL}, v AS (SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC) AS rn FROM ops WHERE kind <> 'get') WHERE rn = 1 AND kind = 'put') SELECT side, key, value FROM v, (VALUES ('engine'), ('model')) AS t(side)")
def met12_replayed_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final view of a workload twice: by the engine, and by replaying it on an ordered map."""
    model: dict[str, str] = {}
    for _, kind, key, value in workload.operations(_WORK):
        if kind == "put":
            model[key.decode()] = value.decode()
        elif kind == "delete":
            model.pop(key.decode(), None)
    ops = met13_workload(spark, sf_dir).where("kind <> 'get'")
    engine = visibility.visible(ops.select(F.col("key").alias("user_key"), (F.col("n") + 1).alias("seq"), (F.col("kind") == "delete").alias("tombstone"), "value"))
    return engine.select(F.lit("engine").alias("side"), "key", "value").unionByName(spark.createDataFrame([("model", k, v) for k, v in sorted(model.items())], "side string, key string, value string"))


# Live figures
_PICK = "list_extract(list_sort(list(s.value)), CAST(ceil({} * (count(s.value) - 1)) AS BIGINT) + 1) AS {}"


@_query(
    "met09_points",
    """WITH s AS (SELECT date_trunc('second', ts) AS sec, value, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events WHERE value IS NOT NULL),
p AS (SELECT sec, count(*) AS operations, max(rn) AS last FROM s GROUP BY sec ORDER BY sec DESC LIMIT 600)
SELECT p.sec, p.operations, """
    + ", ".join(_PICK.format(p, n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
    + " FROM p JOIN s ON s.rn BETWEEN p.last - 4095 AND p.last GROUP BY ALL",
)
def met09_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.points(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_id", "value").withColumnRenamed("at", "sec")


@_query("met15_event_replay", "SELECT event_id, event_type FROM events WHERE event_id > 5000 ORDER BY event_id LIMIT 100")
def met15_event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of events after an id, oldest first: how a client that lost its connection goes on."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id > 5000").orderBy("event_id").limit(100).select("event_id", "event_type")


# Writes
@_query(
    "wrt10_applied_in_order",
    _log("SELECT user_key, n, seq, coalesce(seq > max(seq) OVER (PARTITION BY user_key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS applied FROM l", ", l AS (SELECT user_key, seq AS n, seq - seq % 97 * 50 AS seq FROM log)"),
)
def wrt10_applied_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in the order of arrival, and whether each may be applied: its sequence must exceed the key's newest."""
    arrived = events_log(spark, sf_dir).select("user_key", F.col("seq").alias("n"), (F.col("seq") - F.col("seq") % 97 * 50).alias("seq"))
    return visibility.applied(arrived, "n")


@_query(
    "wrt04_rejected_batches",
    _log("SELECT batch, operations, CASE WHEN k > 2 THEN 'key too long' WHEN v > 9 THEN 'value too long' END AS error FROM (SELECT (seq - 1) // 5 AS batch, count(*) AS operations, max(strlen(user_key)) AS k, max(strlen(value)) AS v FROM log GROUP BY 1)"),
)
def wrt04_rejected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of five entries and what forbids each, if limits are two bytes a key and nine a value; a batch is
    taken whole or not at all."""
    log = events_log(spark, sf_dir).groupBy(F.floor((F.col("seq") - 1) / 5).cast("long").alias("batch"))
    log = log.agg(F.count("*").alias("operations"), F.max(F.octet_length("user_key")).alias("k"), F.max(F.octet_length("value")).alias("v"))
    return log.select("batch", "operations", F.when(F.col("k") > 2, F.lit("key too long")).when(F.col("v") > 9, F.lit("value too long")).alias("error"))


@_query("cmp03_prefix_keeps_history", _log("SELECT user_key, seq, tombstone, value FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)"))
def cmp03_prefix_keeps_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest run of a store after it was merged alone: no version goes."""
    store, _ = _filled(spark, sf_dir)
    with store:
        log = store.log(at=None)
        half = store.runs().where("position = 0").first()["max_sequence"]
        return _texts(retention.prefix_merge(log.where(F.col("seq") <= half)))


@_query("wrt06_group_writes", """WITH t AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation)
SELECT key, value, TRUE AS grouped, (SELECT count(*) FROM t) AS operations FROM t""")
def wrt06_group_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A put a nation, handed to the writer one by one: the view, and whether every commit kept the group limit."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect()  # 25 rows by definition
    with Store.open(spark, work_dir(spark)) as store:
        with Writer(store) as writer:
            for done in [writer.submit([("put", str(r[0]).encode(), r[1].encode())]) for r in rows]:
                done.result()
        m = store.all_metrics()
        limit = store.options.max_group_commit_requests
        grouped = m["grouped_writes"] == len(rows) and -(-len(rows) // limit) <= m["group_commits"] < len(rows)
        return _texts(store.scan()).withColumns({"grouped": F.lit(grouped), "operations": F.lit(m["operations"]).cast("long")})


@_query("api02_session", """WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS n FROM region), o AS (SELECT unnest(['put', 'get', 'delete', 'get']) AS kind, unnest([1, 2, 3, 4]) AS step)
SELECT 4 * n + step AS operation_id, kind, CASE WHEN step = 4 THEN 'NotFound' ELSE 'Ok' END AS status,
  2 * n + CASE step WHEN 1 THEN 0 WHEN 4 THEN 2 ELSE 1 + step // 4 END AS sequence_before,
  2 * n + CASE WHEN step <= 2 THEN 1 ELSE 2 END AS sequence_after FROM r, o""")
def api02_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region put, read, deleted and read again: the session's records."""
    rows = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()  # 5 rows by definition
    with Store.open(spark, work_dir(spark)) as store:
        session = Session(store)
        for r in rows:
            key = str(r["r_regionkey"]).encode()
            session.run("put", key, r["r_name"].encode())
            session.run("get", key)
            session.run("delete", key)
            session.run("get", key)
        return session.frame().select("operation_id", "kind", "status", "sequence_before", "sequence_after")
