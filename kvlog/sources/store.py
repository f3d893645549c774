"""A store of one change log: Parquet runs, atomic manifests, snapshots, compaction.

The manifest with the highest version names all live files; anything else is an orphan.  A commit writes its data
first and then creates the next manifest file exclusively, so it is all or nothing, and a reader is bound to the
immutable files of the manifest it started from.  Small commits stay as deltas (the memory part) until they reach
``memtable_bytes`` and are flushed into a sorted run; when ``compaction_table_trigger`` runs exist, the oldest ones
are merged.  Bulk commits of a mutation DataFrame are numbered and sorted by the cluster; nothing is collected.
"""

from __future__ import annotations

import base64
import json
import os
import socket
import time
import uuid
from collections import Counter, deque
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..model import Closed, Corruption, InvalidArgument, IOFailure, NotFound, Options, ResourceExhausted
from ..operators import retention, visibility
from .files import Files


#: Events that an open store remembers.
EVENTS_KEPT = 10_000
#: (put | delete, key, value or none) in order.
Batch = list[tuple[str, bytes, bytes | None]]


@dataclass(frozen=True)
class Snapshot:
    store_id: str
    open_id: str
    seq: int


@dataclass
class Run:
    name: str
    number: int
    size: int
    entries: int
    logical_bytes: int
    smallest: str
    largest: str
    min_seq: int
    max_seq: int

    @property
    def keys(self) -> tuple[bytes, bytes]:
        return base64.b64decode(self.smallest), base64.b64decode(self.largest)


@dataclass
class State:
    version: int = 0
    store_id: str = ""
    last_sequence: int = 0
    next_number: int = 1
    runs: list[Run] = field(default_factory=list)
    deltas: list[Run] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> bytes:
        return json.dumps(asdict(self), sort_keys=True).encode()

    @staticmethod
    def from_json(data: bytes) -> State:
        try:
            d = json.loads(data)
            s = State(**(d | {"runs": [Run(**r) for r in d["runs"]], "deltas": [Run(**r) for r in d["deltas"]]}))
        except (ValueError, TypeError, KeyError) as e:
            raise Corruption(f"bad manifest: {e}") from None
        last = 0
        for r in [*s.runs, *s.deltas]:
            if not last < r.min_seq <= r.max_seq <= s.last_sequence:
                raise Corruption("runs must have increasing, disjoint sequences")
            last = r.max_seq
        return s


class Store:
    def __init__(self, spark: SparkSession, files: Files, options: Options, state: State, open_id: str):
        self.spark, self.files, self.options, self._state, self._open_id = spark, files, options, state, open_id
        self._snapshots: Counter[int] = Counter()
        self._dead: str | None = None
        self._burnt = state.last_sequence
        self.metrics: Counter[str] = Counter()
        self._events: deque[dict] = deque(maxlen=EVENTS_KEPT)
        self._event_no = 0

    # Opening and closing

    @staticmethod
    def open(spark: SparkSession, path: str, options: Options = Options()) -> Store:
        files = Files(spark, path)
        if not any(n.startswith("manifest-") for n in files.names()):
            if not options.create_if_missing:
                raise NotFound(f"no store at {path}")
            if files.names():
                raise InvalidArgument(f"{path} holds other files")
            files.mkdirs()
        open_id = uuid.uuid4().hex
        _lease(files, open_id, options.lease_seconds)
        try:
            for n in files.names():  # left by a commit that its driver did not live to finish
                if n.startswith(("claim-manifest-", "temporary-")):
                    files.delete(n)
            names = [n for n in files.names() if n.startswith("manifest-") and files.size(n)]
            if not names:
                files.create(_manifest(0), State(store_id=uuid.uuid4().hex).to_json())
                names = [_manifest(0)]
            store = Store(spark, files, options, State.from_json(files.read(names[-1])), open_id)
            live = {r.name for r in store._state.runs + store._state.deltas}
            missing = live - set(files.names("data"))
            if missing:
                raise Corruption(f"missing files: {sorted(missing)}")
            if options.validate_on_open:
                store.validate()
            return store
        except BaseException:
            files.delete("LOCK")
            raise

    def close(self) -> None:
        if self._dead != "closed":
            self._dead = "closed"
            if _holder(self.files).get("open_id") == self._open_id:
                self.files.delete("LOCK")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _event(self, category: str, kind: str, **details) -> None:
        self._event_no += 1
        self._events.append({"id": self._event_no, "at": time.time(), "category": category, "kind": kind, "details": details})

    def _live(self) -> None:
        if self._dead == "closed":
            raise Closed("the store is closed")
        if self._dead:
            raise IOFailure(f"the outcome of a commit is unknown, reopen the store: {self._dead}")

    # Reading

    @property
    def last_sequence(self) -> int:
        return self._state.last_sequence

    def _at(self, snapshot: Snapshot | None) -> int:
        if snapshot is None:
            return self._state.last_sequence
        if (snapshot.store_id, snapshot.open_id) != (self._state.store_id, self._open_id):
            raise InvalidArgument("the snapshot belongs to another store or an earlier open")
        return snapshot.seq

    def log(self, begin: bytes = b"", end: bytes = b"", at: int | None = None, unflushed: bool = True) -> DataFrame:
        """All versions in range: only files whose keys and sequences can matter are opened."""
        self._live()
        model.check_range(begin, end)
        files = self._state.runs + (self._state.deltas if unflushed else [])
        self.metrics["candidate_files"] += len(files)
        names = [r.name for r in files if (not end or r.keys[0] < end) and r.keys[1] >= begin and (at is None or r.min_seq <= at)]
        self.metrics["opened_files"] += len(names)
        if not names:
            return self.spark.createDataFrame([], model.LOG)
        df = self.spark.read.schema(model.LOG).parquet(*[f"{self.files.root}/data/{n}" for n in names])
        return visibility.in_range(df, begin, end)

    def scan(self, begin: bytes = b"", end: bytes = b"", snapshot: Snapshot | None = None) -> DataFrame:
        self.metrics["scans"] += 1
        at = self._at(snapshot)
        return visibility.scan(self.log(begin, end, at), begin, end, at)

    def cursor(self, begin: bytes = b"", end: bytes = b"", snapshot: Snapshot | None = None) -> Cursor:
        at = self._at(snapshot)
        self.metrics["cursors"] += 1
        return Cursor(self.log(begin, end, at), begin, end, at)

    def lookup(self, key: bytes, snapshot: Snapshot | None = None) -> bytes | None:
        at = self._at(snapshot)
        self.metrics["point_lookups"] += 1
        before = self.metrics["opened_files"]
        rows = visibility.get(self.log(key, key + b"\0", at), key, at).take(1)
        self.metrics["point_lookup_files"] += self.metrics["opened_files"] - before
        self.metrics["point_lookups_found" if rows else "point_lookups_missing"] += 1
        return bytes(rows[0]["value"]) if rows else None

    def get(self, key: bytes, snapshot: Snapshot | None = None) -> bytes:
        value = self.lookup(key, snapshot)
        if value is None:
            raise NotFound(repr(key))
        return value

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | None = None) -> DataFrame:
        at = self._at(snapshot)
        self.metrics["multi_gets"] += 1
        return visibility.multi_get(self.log(at=at), keys, at)

    # Snapshots

    def snapshot(self) -> Snapshot:
        self._live()
        most = self.options.max_active_snapshots
        if most and sum(self._snapshots.values()) >= most:
            raise ResourceExhausted("too many active snapshots")
        self._snapshots[self._state.last_sequence] += 1
        self.metrics["snapshots_taken"] += 1
        self._event("snapshot", "taken", seq=self._state.last_sequence)
        return Snapshot(self._state.store_id, self._open_id, self._state.last_sequence)

    def release(self, snapshot: Snapshot) -> None:
        self._at(snapshot)
        if self._snapshots[snapshot.seq] > 1:
            self._snapshots[snapshot.seq] -= 1
        else:
            self._snapshots.pop(snapshot.seq, None)
        self.metrics["snapshots_released"] += 1
        self._event("snapshot", "released", seq=snapshot.seq)

    @property
    def watermark(self) -> int | None:
        return min(self._snapshots, default=None)

    # Writing

    def put(self, key: bytes, value: bytes) -> None:
        self.write([("put", key, value)])

    def delete(self, key: bytes) -> None:
        self.write([("delete", key, None)])

    def write(self, batch: Batch) -> None:
        """An atomic, ordered batch of (put | delete, key, value); the last operation on a key wins."""
        self.write_group([batch])

    def check(self, batch: Batch) -> int:
        """Bytes of the keys and values of a batch that may be written."""
        total = 0
        for op, key, value in batch:
            if op not in ("put", "delete") or (op == "put") != (value is not None):
                raise InvalidArgument(f"bad operation {op!r}")
            if len(key) > self.options.max_key_bytes or len(value or b"") > self.options.max_value_bytes:
                raise InvalidArgument("a key or value is too long")
            total += len(key) + len(value or b"")
        if len(batch) > model.BATCH_OPS or total > model.BATCH_BYTES:
            raise InvalidArgument("the batch is too large")
        return total

    def write_group(self, batches: list[Batch]) -> None:
        """Batches, one after another, as one commit: one job and one manifest for all of them."""
        self._live()
        batches = [b for b in batches if b]
        total = sum(self.check(b) for b in batches)
        operations = [o for b in batches for o in b]
        if not operations:
            return
        first = self._reserve(len(operations))
        rows = [(bytearray(k), first + i, op == "delete", None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(operations)]
        df = self.spark.createDataFrame(rows, model.LOG).coalesce(1)
        keys = [k for _, k, _ in operations]
        run = self._store(df, len(rows), total, min(keys), max(keys), first, first + len(rows) - 1)
        self._publish(deltas=[*self._state.deltas, run], last_sequence=run.max_seq, counters=self._counted(logical_writes=len(batches), operations=len(rows), logical_write_bytes=total))
        held = sum(r.logical_bytes + r.entries * self.options.entry_overhead_bytes for r in self._state.deltas)
        if held >= self.options.memtable_bytes:
            self.flush()

    def write_frame(self, mutations: DataFrame, batch_id: str | None = None) -> None:
        """A mutation DataFrame (ordinal, op, key, value) as one commit; a known ``batch_id`` is skipped.  Ids of the
        form ``name/number`` must come in order of their numbers; only the last of each name is kept.

        Sequences follow the order of ordinals without a global window: rows are range-partitioned by ordinal and
        stored, and only the row count of each partition comes to the driver.
        """
        self._live()
        if batch_id is not None and self._committed(batch_id):
            return
        bad = ~F.col("op").isin("put", "delete") | F.col("key").isNull() | ((F.col("op") == "put") != F.col("value").isNotNull())
        bad |= (F.octet_length("key") > self.options.max_key_bytes) | (F.coalesce(F.octet_length("value"), F.lit(0)) > self.options.max_value_bytes)
        staged = f"stage-{uuid.uuid4().hex}"
        where = f"{self.files.root}/data/{staged}"
        ordered = mutations.repartitionByRange("ordinal").sortWithinPartitions("ordinal").withColumn("part", F.spark_partition_id())
        ordered.withColumn("bad", F.coalesce(bad, F.lit(True))).write.parquet(where)
        try:
            rows = self.spark.read.parquet(where)
            size = F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0))
            parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"), F.sum(size).alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
            if any(p["bad"] for p in parts):
                raise InvalidArgument("the frame holds an invalid operation")
            n = sum(p["n"] for p in parts)
            if not n:
                return
            first, offset = self._reserve(n), {}
            at = first
            for p in parts:
                offset[p["part"]], at = at, at + p["n"]
            base = self.spark.createDataFrame(list(offset.items()), "part int, base long")
            w = Window.partitionBy("part").orderBy("ordinal")
            numbered = rows.withColumn("__n", F.row_number().over(w) - 1).join(base, "part")
            log = numbered.select(F.col("key").alias("user_key"), (F.col("base") + F.col("__n")).alias("seq"), (F.col("op") == "delete").alias("tombstone"), "value")
            run = self._store(_sorted(log), n, sum(p["bytes"] for p in parts), min(bytes(p["lo"]) for p in parts), max(bytes(p["hi"]) for p in parts), first, first + n - 1)
        finally:
            self.files.delete(f"data/{staged}")
        if self._state.deltas:
            self.flush()  # runs stay in sequence order
        name, number = _series(batch_id or "")
        batches = self._state.batches if batch_id is None else self._state.batches | {name: run.max_seq if number is None else number}
        self._publish(runs=[*self._state.runs, run], last_sequence=run.max_seq, batches=batches, counters=self._counted(logical_writes=1, operations=n, logical_write_bytes=run.logical_bytes, flush_bytes=run.size))
        self._compact_due()

    def _committed(self, batch_id: str) -> bool:
        name, number = _series(batch_id)
        known = self._state.batches
        return batch_id in known or (number is not None and known.get(name, -1) >= number)

    def _reserve(self, n: int) -> int:
        first = max(self._burnt, self._state.last_sequence) + 1
        if first + n - 1 > model.MAX_SEQUENCE:
            raise ResourceExhausted("sequence numbers are used up")
        self._burnt = first + n - 1  # a failed commit never gives its numbers back
        return first

    def _store(self, df: DataFrame, entries: int, logical: int, smallest: bytes, largest: bytes, low: int, high: int) -> Run:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.files.root}/data/{name}")
        number = self._state.next_number
        code = lambda b: base64.b64encode(b).decode()
        return Run(name, number, self.files.size(f"data/{name}"), entries, logical, code(smallest), code(largest), low, high)

    def _counted(self, **more: int) -> dict[str, int]:
        return dict(Counter(self._state.counters) + Counter(more))

    def _publish(self, **changes) -> None:
        _renew(self.files, self._open_id, self.options.lease_seconds)
        d = asdict(self._state) | {k: [asdict(r) for r in v] if k in ("runs", "deltas") else v for k, v in changes.items()}
        d["version"] += 1
        live = d["runs"] + d["deltas"]
        d["next_number"] = max([d["next_number"], *(r["number"] + 1 for r in live)])
        new = State.from_json(json.dumps(d).encode())
        try:
            created = self.files.create(_manifest(new.version), new.to_json())
        except Exception as e:
            self._dead = str(e)[:200]
            raise IOFailure(self._dead) from e
        if not created:
            self._dead = "another writer has committed"
            raise IOFailure(self._dead)
        self._state = new
        self._event("commit", "published", version=new.version, last_sequence=new.last_sequence, runs=len(new.runs), deltas=len(new.deltas))

    # Flush, compaction, cleaning

    def flush(self) -> None:
        """Deltas become one sorted run."""
        self._live()
        if not self._state.deltas:
            return
        paths = [f"{self.files.root}/data/{r.name}" for r in self._state.deltas]
        began = time.perf_counter()
        run = self._merged(self.spark.read.schema(model.LOG).parquet(*paths), self._state.deltas)
        self._event("flush", "finished", entries=run.entries, bytes=run.size, seconds=round(time.perf_counter() - began, 3))
        self._publish(runs=[*self._state.runs, run], deltas=[], counters=self._counted(flushes=1, flush_bytes=run.size))
        self._compact_due()

    def _merged(self, log: DataFrame, sources: list[Run]) -> Run | None:
        stats = log.agg(F.count("*"), F.sum(F.octet_length("user_key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0))), F.min("user_key"), F.max("user_key"), F.min("seq"), F.max("seq")).first()
        if not stats[0]:
            return None
        return self._store(_sorted(log), stats[0], stats[1], bytes(stats[2]), bytes(stats[3]), stats[4], stats[5])

    def _compact_due(self) -> None:
        trigger = self.options.compaction_table_trigger
        while trigger and len(self._state.runs) >= trigger:
            self._compact(trigger)

    def compact(self) -> None:
        """Merge all runs; deltas are not touched."""
        self._live()
        if self._state.runs:
            self._compact(len(self._state.runs))

    def _compact(self, count: int) -> None:
        old = self._state.runs[:count]
        log = self.spark.read.schema(model.LOG).parquet(*[f"{self.files.root}/data/{r.name}" for r in old])
        full = count == len(self._state.runs)
        kept = retention.compact(log, self.watermark) if full else retention.prefix_merge(log)
        began = time.perf_counter()
        run = self._merged(kept, old)
        self._event("compaction", "full" if full else "prefix", inputs=count, entries=run.entries if run else 0, seconds=round(time.perf_counter() - began, 3))
        self.metrics["compaction_inputs"] += count
        more = {"compactions": 1, "compaction_input_bytes": sum(r.size for r in old), "compaction_output_bytes": run.size if run else 0}
        counters = self._counted(**more)
        if full:
            counters |= {"retained_versions": run.entries if run else 0, "retained_bytes": run.logical_bytes if run else 0}
        self._publish(runs=[*([run] if run else []), *self._state.runs[count:]], counters=counters)

    def vacuum(self, keep_manifests: int = 10) -> list[str]:
        """Delete files that none of the newest manifests names; views bound to older ones end."""
        self._live()
        manifests = [n for n in self.files.names() if n.startswith("manifest-")]
        live = set()
        for n in manifests[-keep_manifests:]:
            s = State.from_json(self.files.read(n))
            live |= {r.name for r in s.runs + s.deltas}
        gone = [f"data/{n}" for n in self.files.names("data") if n not in live] + manifests[:-keep_manifests]
        for n in gone:
            self.files.delete(n)
        return gone

    def validate(self) -> None:
        """Compare every live file with its manifest row, all in one job, and look for repeated versions."""
        live = self._state.runs + self._state.deltas
        if not live:
            return
        df = self.spark.read.schema(model.LOG).parquet(*[f"{self.files.root}/data/{r.name}" for r in live])
        name = F.element_at(F.split(F.input_file_name(), "/"), -2)
        got = df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("user_key"), F.max("user_key"), F.min("seq"), F.max("seq"))
        found = {g[0]: g for g in got.collect()}  # one row a live file, as many as the manifest has
        for r in live:
            g = found.get(r.name)
            if g is None or (g[1], bytes(g[2]), bytes(g[3])) != (r.entries, *r.keys) or not r.min_seq <= g[4] <= g[5] <= r.max_seq:
                raise Corruption(f"run {r.number} differs from the manifest")
        visibility.require_unique(self.log())

    # Diagnostics

    def runs(self) -> DataFrame:
        rows = [(i, r.number, r.size, bytearray(r.keys[0]), bytearray(r.keys[1]), r.min_seq, r.max_seq) for i, r in enumerate(self._state.runs)]
        return self.spark.createDataFrame(rows, model.RUNS)

    def files_listing(self) -> DataFrame:
        """(name, kind, state, bytes) of everything in the store's folder."""
        live = {r.name for r in self._state.runs} | {r.name for r in self._state.deltas}
        rows = [(n, "manifest", "live" if n == _manifest(self._state.version) else "old", self.files.size(n)) for n in self.files.names() if n.startswith("manifest-")]
        rows += [(n, "temporary" if n.startswith("stage-") else "run", "live" if n in live else "temporary" if n.startswith("stage-") else "orphan", self.files.size(f"data/{n}")) for n in self.files.names("data")]
        return self.spark.createDataFrame(rows, "name string, kind string, state string, bytes long")

    def events(self, after: int | None = None, limit: int = 100) -> list[dict]:
        """The newest ``limit`` events, newest first; or the first ``limit`` after event ``after``, oldest first, which
        is how a reader that lost its connection goes on.  The newest EVENTS_KEPT are held."""
        if after is None:
            return list(reversed(self._events))[:limit]
        return [e for e in self._events if e["id"] > after][:limit]

    def diagnostics(self) -> dict:
        """Everything about the store at one moment: identity, options, metrics, runs, snapshots and newest events."""
        return {
            "store_id": self._state.store_id,
            "version": self._state.version,
            "options": asdict(self.options),
            "metrics": self.all_metrics(),
            "runs": [asdict(r) for r in self._state.runs],
            "deltas": [asdict(r) for r in self._state.deltas],
            "snapshots": sorted(self._snapshots.elements()),
            "events": self.events(),
        }

    def bytes_by_kind(self) -> DataFrame:
        """(kind, state, files, bytes) of the store's folder."""
        return self.files_listing().groupBy("kind", "state").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))

    def all_metrics(self) -> dict[str, float | int | None]:
        """Counters of commits and reads; block cache and lock figures have no counterpart and are null."""
        c = Counter(self._state.counters)
        live, trigger, runs = sum(r.size for r in self._state.runs), self.options.compaction_table_trigger, self._state.runs
        debt = max(0, len(runs) - trigger + 1) if trigger else 0
        return dict(c) | dict(self.metrics) | {
            "live_tables": len(runs),
            "last_sequence": self._state.last_sequence,
            "live_entries": sum(r.entries for r in runs),
            "live_logical_bytes": sum(r.logical_bytes for r in runs),
            "live_bytes": live,
            "debt_tables": debt,
            "debt_bytes": sum(r.size for r in runs[:trigger]) if debt else 0,
            "deltas": len(self._state.deltas),
            "delta_entries": sum(r.entries for r in self._state.deltas),
            "delta_bytes": sum(r.logical_bytes for r in self._state.deltas),
            "read_amplification": self.metrics["point_lookup_files"] / self.metrics["point_lookups"] if self.metrics["point_lookups"] else 0.0,
            "active_snapshots": sum(self._snapshots.values()),
            "oldest_snapshot": self.watermark,
            "write_amplification": (c["flush_bytes"] + c["compaction_output_bytes"]) / c["logical_write_bytes"] if c["logical_write_bytes"] else 0.0,
            "block_cache_hits": None,
            "lock_wait_micros": None,
        }


class Cursor:
    """Entries in key order, bound to one state of the store; it outlives writes, compaction and close."""

    def __init__(self, log: DataFrame, begin: bytes, end: bytes, at: int):
        self._log, self._begin, self._end, self._at = log, begin, end, at
        self._rows = None
        self._row = None

    def seek(self, target: bytes) -> None:
        first = max(target, self._begin)
        if self._end and first >= self._end:
            self._rows, self._row = iter(()), None
            return
        self._rows = iter(visibility.scan(self._log, first, self._end, self._at).toLocalIterator())
        self.next()

    def next(self) -> None:
        self._row = next(self._rows, None)

    def valid(self) -> bool:
        if self._rows is None:
            self.seek(self._begin)
        return self._row is not None

    @property
    def key(self) -> bytes:
        return bytes(self._row["key"])

    @property
    def value(self) -> bytes:
        return bytes(self._row["value"])


def _holder(files: Files) -> dict:
    try:
        return json.loads(files.read("LOCK"))
    except Exception:  # gone, or of an unknown form
        return {}


def _lease_text(open_id: str, seconds: float) -> bytes:
    return json.dumps({"open_id": open_id, "host": socket.gethostname(), "pid": os.getpid(), "until": time.time() + seconds}).encode()


def _lease(files: Files, open_id: str, seconds: float) -> None:
    """Become the store's one opener.  The lock of an opener that has died goes: its process is gone from this host,
    or its lease has run out.  Commits are safe even if it still lives, because a manifest is created exclusively."""
    if files.exists("LOCK"):
        holder = _holder(files)
        dead = holder.get("host") == socket.gethostname() and not _alive(holder.get("pid", 0))
        if not dead and holder.get("until", 0) > time.time():
            raise IOFailure(f"{files.root} is open already")
        files.delete("LOCK")
    if not files.create("LOCK", _lease_text(open_id, seconds)):
        raise IOFailure(f"{files.root} is open already")


def _renew(files: Files, open_id: str, seconds: float) -> None:
    holder = _holder(files)
    if holder.get("open_id") == open_id and holder["until"] - time.time() < seconds / 2:
        files.delete("LOCK")
        files.create("LOCK", _lease_text(open_id, seconds))


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return pid > 0


def _series(batch_id: str) -> tuple[str, int | None]:
    """The key under which a batch is remembered, and its number if it is one of a series."""
    name, slash, number = batch_id.rpartition("/")
    return (name + slash, int(number)) if slash and number.isdecimal() else (batch_id, None)


def _manifest(version: int) -> str:
    return f"manifest-{version:020d}.json"


def _sorted(log: DataFrame) -> DataFrame:
    """Laid out for pruning: ranges of keys, versions newest first.  Every key's versions share a file."""
    return log.repartitionByRange("user_key").sortWithinPartitions("user_key", F.desc("seq"))
