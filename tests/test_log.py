import io
import random
import threading

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlog import cli, model
from kvlog.functions import folds, formats, workload
from kvlog.functions.formats import Entry
from kvlog.functions.session import Session
from kvlog.operators import retention, visibility
from kvlog.sources.store import Store
from kvlog.sources.writer import Writer
from kvlog.sources.wal import WalSource, read_wal


def log(spark, rows):
    return spark.createDataFrame([(bytearray(k), s, v is None, None if v is None else bytearray(v)) for k, s, v in rows], model.LOG)


def view(df):
    return sorted((bytes(r["key"]), bytes(r["value"])) for r in df.collect())


def test_visibility_filters_before_and_after(spark):
    df = log(spark, [(b"a", 1, b"old-a"), (b"b", 2, b"old-b"), (b"a", 4, b"new-a"), (b"b", 5, None), (b"c", 6, b"")])
    for form in ("rank", "hash"):
        assert view(visibility.visible(df, 3, form=form)) == [(b"a", b"old-a"), (b"b", b"old-b")]
        assert view(visibility.visible(df, form=form)) == [(b"a", b"new-a"), (b"c", b"")]
    assert view(visibility.visible(df, None, b"b", b"")) == [(b"c", b"")]
    assert view(visibility.visible(df, None, b"a", b"a")) == []
    with pytest.raises(model.InvalidArgument):
        visibility.visible(df, None, b"b", b"a")


def test_byte_order_and_many_versions(spark):
    df = log(spark, [(b"\x80", 1, b"x"), (b"\0\x80", 2, b"v\0\xff"), (b"\0", 3, b"z")])
    assert [bytes(r["key"]) for r in visibility.scan(df).collect()] == [b"\0", b"\0\x80", b"\x80"]
    many = log(spark, [(b"a", s, b"%d" % s) for s in range(1, 41)])
    assert view(visibility.get(many, b"a")) == [(b"a", b"40")]


def test_duplicates_are_corruption(spark):
    with pytest.raises(model.Corruption):
        visibility.require_unique(log(spark, [(b"a", 7, b"one"), (b"a", 7, b"two")]))


def test_retention_keeps_views(spark):
    rng = random.Random(5)
    rows = [(rng.choice([b"a", b"b", b"c", b"d"]), s, None if rng.random() < 0.25 else b"%d" % s) for s in range(1, 200)]
    df = log(spark, rows)
    kept = retention.compact(df, 100)
    for at in (100, 150, 199):
        assert view(visibility.visible(kept, at)) == view(visibility.visible(df, at))
    assert view(visibility.visible(retention.compact(df))) == view(visibility.visible(df))
    assert retention.compact(log(spark, [(b"g", 1, None)])).count() == 0
    assert retention.compact(log(spark, [(b"g", 1, None)]), 1).count() == 1


def test_crc_and_golden_manifests():
    assert formats.crc32c(b"123456789") == 0xE3069283
    m = formats.decode_manifest(bytes.fromhex("4d4e46310100000004000000293b9cc508011002"))
    assert (m.active_wal_number, m.next_file_number, m.last_sequence, m.live_tables) == (1, 2, 0, [])
    m = formats.decode_manifest(bytes.fromhex("4d4e463101000000160000008ae814d30807100b182a220e080910641a016122017a2801302a"))
    assert m.live_tables == [formats.TableMeta(9, 100, b"a", b"z", 1, 42)] and m.last_sequence == 42
    assert formats.decode_manifest(formats.encode_manifest(m)) == m


ENTRIES = [Entry(b"account/001", 3, False, b"one"), Entry(b"account/002", 2, False, b"two"), Entry(b"account/003", 1, True)]


def test_blocks_and_tables():
    assert formats.decode_block_v2(formats.encode_block_v2(ENTRIES, 2)) == ENTRIES
    assert formats.decode_block_v1(formats.encode_block_v1(ENTRIES)) == ENTRIES
    assert formats.find_in_block(ENTRIES, b"account/002", 2).value == b"two"
    versions = [Entry(b"k", s, False, b"%d" % s) for s in range(40, 0, -1)]
    assert formats.find_in_block(formats.decode_block_v2(formats.encode_block_v2(versions, 16)), b"k", 99).seq == 40
    table = formats.encode_table(ENTRIES + [Entry(b"b%04d" % i, i + 10, False, b"x" * 50) for i in range(100)], 512, 4)
    entries, refs, props = formats.decode_table(table)
    assert len(entries) == 103 and len(refs) > 5 and props.max_sequence == 109
    with pytest.raises(model.Corruption):
        formats.decode_block_v2(b"x" + formats.encode_block_v2(ENTRIES)[1:])


def test_log_records(tmp_path, spark):
    data = formats.encode_record(Entry(b"a", 1, False, b"x")) + formats.encode_batch([Entry(b"b", 2, False, b"y"), Entry(b"a", 3, True)])
    got, used = formats.decode_log(data)
    assert [e.seq for _, e in got] == [1, 2, 3] and used == len(data)
    for cut in range(1, 50):
        assert len(formats.decode_log(data[:-cut])[0]) == 1 or cut > len(data) - 34
    with pytest.raises(model.Corruption):
        formats.decode_log(data, floor=1)
    (tmp_path / "000001.wal").write_bytes(data)
    assert read_wal(spark, str(tmp_path)).count() == 3
    spark.dataSource.register(WalSource)
    assert spark.read.format("kvwal").load(str(tmp_path / "000001.wal")).count() == 3


def test_file_names():
    assert formats.parse_file_name("000012.sst.tmp") == (12, "sst.tmp")
    assert [formats.parse_file_name(x) for x in ("12.sst", "0000012.sst", "000000.wal", "000012.txt")] == [None] * 4


def test_folds():
    assert folds.pack_groups([5, 5, 200, 5, 5], 2, 100) == [0, 0, 1, 2, 2]
    assert folds.rotate([60, 60, 60, 60], [0, 0, 1, 1], 100) == [0, 0, 1, 1]
    blocks = folds.cut_blocks([(b"a", 100)] * 5 + [(b"b", 100)] * 2, 300)
    assert blocks[:5] == [0] * 5 and blocks[5] == 1


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.booleans(), st.binary(max_size=9)), min_size=1, max_size=30))
def test_any_batch_round_trips(rows):
    entries = [Entry(k, i + 1, t, b"" if t else v) for i, (k, t, v) in enumerate(rows)]
    assert [e for _, e in formats.decode_log(formats.encode_batch(entries))[0]] == entries


def test_store_semantics(spark, tmp_path):
    opts = model.Options(compaction_table_trigger=0, max_key_bytes=3, max_value_bytes=4, max_active_snapshots=1)
    path = str(tmp_path / "s")
    with Store.open(spark, path, opts) as s:
        with pytest.raises(model.IOFailure):
            Store.open(spark, path)
        s.write([])
        assert s.last_sequence == 0
        s.write([("put", b"a", b"old"), ("put", b"b", b"two"), ("delete", b"a", None), ("put", b"a", b"new"), ("put", b"e", b"")])
        s.delete(b"zz")
        with pytest.raises(model.InvalidArgument):
            s.write([("put", b"ok", b"data"), ("put", b"long", b"data")])
        assert s.last_sequence == 6 and s.get(b"a") == b"new" and s.get(b"e") == b""
        with pytest.raises(model.NotFound):
            s.get(b"zz")
        snap = s.snapshot()
        with pytest.raises(model.ResourceExhausted):
            s.snapshot()
        s.flush()
        s.put(b"a", b"x")
        s.flush()
        cursor = s.cursor(b"b", b"", snap)
        s.compact()
        assert s.get(b"a", snap) == b"new" and s.get(b"a") == b"x"
        cursor.seek(b"a")
        assert cursor.key == b"b"
        s.release(snap)
        s.compact()
        assert s.all_metrics()["retained_versions"] == 3
    with Store.open(spark, path, opts) as s:
        assert view(s.scan()) == [(b"a", b"x"), (b"b", b"two"), (b"e", b"")]
        with pytest.raises(model.InvalidArgument):
            s.get(b"a", snap)
        s.validate()
        s.vacuum(1)
        assert s.files_listing().where("state <> 'live'").count() == 0
        m = spark.createDataFrame([(2, "put", bytearray(b"q"), bytearray(b"2")), (1, "put", bytearray(b"q"), bytearray(b"1"))], model.MUTATION)
        s.write_frame(m, "batch-1")
        s.write_frame(m, "batch-1")
        assert s.get(b"q") == b"2" and s.last_sequence == 9


def test_tombstone_only_compaction_and_workload(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "t"), model.Options(compaction_table_trigger=2)) as s:
        s.delete(b"gone")
        s.flush()
        s.compact()
        assert s.runs().count() == 0 and s.last_sequence == 1
        assert workload.replay(s, workload.Workload(operation_count=12)) == []


def test_missing_run_is_corruption(spark, tmp_path):
    path = str(tmp_path / "m")
    with Store.open(spark, path) as s:
        s.put(b"a", b"1")
        s.files.delete(f"data/{s.files.names('data')[0]}")
    with pytest.raises(model.Corruption):
        Store.open(spark, path)


def test_cli(spark, tmp_path):
    def run(*a):
        out = io.StringIO()
        return cli.main([str(tmp_path / "c"), *a], out, spark), out.getvalue()

    assert run("put", "alpha", "one")[0] == 0 and run("put", "beta", "two")[0] == 0
    assert run("scan") == (0, "alpha\tone\nbeta\ttwo\n")
    assert run("scan", "a", "b", "--json") == (0, '{"key_base64":"YWxwaGE=","value_base64":"b25l"}\n')
    assert run("get", "none")[0] == 3 and run("nonsense")[0] == 2


def test_options():
    for bad in ({"memtable_bytes": 0}, {"compaction_table_trigger": 1}):
        with pytest.raises(model.InvalidArgument):
            model.Options(**bad)


def test_workload_follows_its_generator():
    """Worked out by hand from the generator: state = state * multiplier + increment, first key, then kind."""
    state, want = 9, []
    draws = []
    for _ in range(12):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        draws.append(state)
    for n in range(4):
        which, slot, kind = draws[3 * n : 3 * n + 3]
        slot = slot % 2 if which % 100 < 80 else slot % 10
        want.append((n, "put" if kind % 100 < 50 else "get" if kind % 100 < 80 else "delete", b"key-%08d" % slot))
    got = list(workload.operations(workload.Workload(operation_count=4, seed=9)))
    assert [g[:3] for g in got] == want
    assert all(v is None or (len(v) == 16 and v.startswith(b"value-%d" % n)) for n, _, _, v in got)


def test_store_survives_a_killed_opener(spark, tmp_path):
    path = str(tmp_path / "k")
    s = Store.open(spark, path)
    s.put(b"a", b"1")
    with pytest.raises(model.IOFailure):
        Store.open(spark, path)
    import json
    import subprocess
    import sys

    child = subprocess.Popen([sys.executable, "-c", ""])
    child.wait()
    holder = json.loads(s.files.read("LOCK"))
    for gone in (holder | {"pid": child.pid}, holder | {"host": "elsewhere", "until": 0}):
        s.files.delete("LOCK")
        assert s.files.create("LOCK", json.dumps(gone).encode())
        with Store.open(spark, path) as again:
            assert again.get(b"a") == b"1"
        assert not s.files.exists("LOCK")
        assert s.files.create("LOCK", json.dumps(holder).encode())
    s.files.delete("LOCK")
    assert s.files.create("LOCK", json.dumps(holder | {"host": "elsewhere"}).encode())
    with pytest.raises(model.IOFailure):
        Store.open(spark, path)


def test_a_commit_that_its_driver_did_not_finish_is_not_there(spark, tmp_path):
    path = str(tmp_path / "c")
    with Store.open(spark, path) as s:
        s.put(b"a", b"1")
    (tmp_path / "c" / "temporary-x").write_bytes(b"{")
    (tmp_path / "c" / "claim-manifest-00000000000000000002.json").write_bytes(b"")
    (tmp_path / "c" / "manifest-00000000000000000002.json").write_bytes(b"")
    with Store.open(spark, path) as s:
        assert s.get(b"a") == b"1"
    (tmp_path / "c" / "manifest-00000000000000000003.json").write_bytes(b"{}")
    with pytest.raises(model.Corruption):
        Store.open(spark, path)


def test_files_are_whole_or_absent(spark, tmp_path):
    from kvlog.sources.files import Files

    files = Files(spark, str(tmp_path / "f"))
    files.mkdirs()
    assert files.create("x", b"one") and not files.create("x", b"two") and files.read("x") == b"one"
    assert files.names() == ["x"] or files.names() == [".x.crc", "x"]


def test_wal_limits_floor_and_torn_tails(spark, tmp_path):
    data = formats.encode_batch([Entry(b"a", 5, False, b"x"), Entry(b"bb", 6, True)]) + formats.encode_record(Entry(b"c", 7, False, b"yy"))
    with pytest.raises(model.Corruption):
        formats.decode_log(data, 0, max_key_bytes=1)
    with pytest.raises(model.Corruption):
        formats.decode_log(data, 0, max_value_bytes=1)
    for n in (1, 2):
        (tmp_path / f"00000{n}.wal").write_bytes(data[: None if n == 1 else -1])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    from kvlog.sources.wal import recover_wal

    got = [tuple(r)[1:] for r in recover_wal(files).orderBy("path").collect()]
    assert [g[0] for g in got] == [3, 2] and [g[3] for g in got] == [False, True] and got[0][2] == len(data)
    assert all(r["error"] for r in recover_wal(files, floor=5).collect())
    spark.dataSource.register(WalSource)
    df = spark.read.format("kvwal").load(str(tmp_path))
    assert df.count() == 5 and df.rdd.getNumPartitions() == 2


def test_group_packing_counts_operations():
    pack = folds.GroupPacker(8, 100, 10)
    assert [pack(1, n) for n in (4, 6, 1, 20, 1)] == [0, 0, 1, 2, 3]
    assert folds.pack_groups([100, 0, 0], 8, 100) == [0, 1, 1]


def test_frame_with_deletes(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "d")) as s:
        s.write_frame(spark.createDataFrame([(1, "put", bytearray(b"q"), bytearray(b"1")), (2, "delete", bytearray(b"q"), None), (3, "put", bytearray(b"r"), bytearray(b""))], "ordinal long, op string, key binary, value binary"))
        assert view(s.scan()) == [(b"r", b"")]
        s.validate()


def test_events_diagnostics_and_counters(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "e"), model.Options(compaction_table_trigger=0)) as s:
        s.put(b"a", b"1")
        snap = s.snapshot()
        s.flush()
        s.put(b"b", b"2")
        s.flush()
        s.compact()
        s.release(snap)
        assert s.get(b"a") == b"1" and s.lookup(b"zz") is None
        kinds = [(e["category"], e["kind"]) for e in s.events(after=0, limit=1000)]
        assert kinds[:3] == [("commit", "published"), ("snapshot", "taken"), ("flush", "finished")] and ("compaction", "full") in kinds
        third = s.events(after=0)[2]["id"]
        assert [e["id"] for e in s.events(after=third, limit=2)] == [third + 1, third + 2] and s.events(limit=1)[0]["kind"] == "released"
        d = s.diagnostics()
        assert d["metrics"]["point_lookups_found"] == 1 and d["metrics"]["point_lookups_missing"] == 1 and d["metrics"]["read_amplification"] <= 1
        assert len(d["runs"]) == 1 and d["snapshots"] == [] and d["metrics"]["compaction_inputs"] == 2


def test_table_files_as_a_source(spark, tmp_path):
    entries = sorted((Entry(b"k%03d" % (i % 40), i + 1, i % 7 == 0, b"" if i % 7 == 0 else b"v%d" % i) for i in range(200)), key=lambda e: (e.key, -e.seq))
    (tmp_path / "000001.sst").write_bytes(formats.encode_table(entries, 512))
    from kvlog.sources.tables import inspect_tables, read_tables

    got = [(bytes(r["user_key"]), r["seq"], r["tombstone"]) for r in read_tables(spark, str(tmp_path)).collect()]
    assert got == [(e.key, e.seq, e.tombstone) for e in entries]
    blocks = inspect_tables(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("block").collect()
    assert sum(b["entries"] for b in blocks) == 200 and blocks[0]["offset"] == 0 and len(blocks) > 3
    assert all(a["offset"] + a["size"] == b["offset"] for a, b in zip(blocks, blocks[1:]))


def test_log_files_are_appended(spark, tmp_path):
    spark.dataSource.register(WalSource)
    path = str(tmp_path / "wal")
    rows = [(b"k%d" % (i % 9), i, i % 5 == 0, None if i % 5 == 0 else b"v") for i in range(1, 301)]
    for part in (rows[:200], rows[200:]):
        df = spark.createDataFrame([(bytearray(k), s, t, None if v is None else bytearray(v)) for k, s, t, v in part], "user_key binary, seq long, tombstone boolean, value binary")
        df.repartitionByRange(3, "seq").write.format("kvwal").mode("append").option("batch", 50).save(path)
    got = sorted((r["seq"], bytes(r["user_key"]), r["tombstone"]) for r in read_wal(spark, path).collect())
    assert got == [(s, k, t) for k, s, t, _ in rows]
    import os

    names = sorted(os.listdir(path))
    assert len(names) == 6 and all(formats.parse_file_name(n) for n in names)


def test_writer_groups_orders_and_bounds(spark, tmp_path):
    opts = model.Options(max_pending_write_requests=4, max_pending_write_bytes=100, max_group_commit_requests=3)
    with Store.open(spark, str(tmp_path / "w"), opts) as s:
        groups, commit, started, gate = [], s.write_group, threading.Event(), threading.Event()
        s.write_group = lambda g: (started.set(), gate.wait(60), groups.append(len(g)), commit(g))[-1]
        with Writer(s) as w:
            put = lambda n: w.submit([("put", b"k", b"%d" % n), ("put", b"n%d" % n, b"")])
            waiting = [put(0)]
            assert started.wait(60)  # the committer holds the first and stands at the gate
            waiting += [put(n) for n in range(1, 5)]
            late = threading.Thread(target=lambda: waiting.append(put(5)))
            late.start()
            late.join(0.5)
            assert late.is_alive()  # the queue is full
            gate.set()
            late.join(60)
            seen = w.call(lambda: s.last_sequence)
            for x in waiting:
                x.result(60)
            assert seen == 12 and groups[0] == 1 and sum(groups) == 6 and max(groups) <= 3 and len(groups) < 6
            with pytest.raises(model.ResourceExhausted):
                w.submit([("put", b"k", bytes(100))])
            with pytest.raises(model.InvalidArgument):
                w.submit([("put", b"k", None)])
            w.write([])
        assert s.get(b"k") == b"5" and s.scan().count() == 7 and s.metrics["max_writer_queue_depth"] == 4
        with pytest.raises(model.Closed):
            w.submit([("put", b"k", b"")])


def test_writer_hands_errors_to_its_callers(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "w")) as s, Writer(s) as w:
        with pytest.raises(ZeroDivisionError):
            w.call(lambda: 1 // 0)
        s._dead = "gone"
        with pytest.raises(model.IOFailure):
            w.write([("put", b"k", b"")])
        s._dead = None
        w.write([("put", b"k", b"v")])
        assert s.get(b"k") == b"v"


def test_session_records(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        session = Session(s)
        assert session.run("get", b"a")["status"] == "NotFound"
        put = session.run("put", b"a", b"1")
        assert put["status"] == "Ok" and put["after"]["last_sequence"] == put["before"]["last_sequence"] + 1
        assert session.run("get", b"a")["value"] == b"1"
        assert view(session.run("scan")["entries"]) == [(b"a", b"1")]
        assert session.run("scan", begin=b"b", end=b"a")["status"] == "InvalidArgument"
        assert [r["kind"] for r in session.operations(2)] == ["scan", "scan"] and session.counts["get", False] == 1
        assert session.frame().count() == 5
        with pytest.raises(model.InvalidArgument):
            session.run("sing")
        assert [e["kind"] for e in s.events(limit=2)] == ["error", "start"]
    assert session.run("put", b"a", b"2")["status"] == "Closed"


def test_crc_forms_agree():
    def slow(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = random.Random(3)
    buffers = [rng.randbytes(n) for n in (*range(40), 255, 256, 257, 4095, 4096, 4097, 5000, 65536, 70001)] + [b"\0" * 33, b"\xff" * 9000]
    rng.shuffle(buffers)
    want = [slow(b) for b in buffers]
    assert [formats.crc32c(b) for b in buffers] == want == formats.crc32c_many(buffers)


def test_series_of_batches_keep_their_last_number(spark, tmp_path):
    row = lambda k: spark.createDataFrame([(1, "put", bytearray(k), bytearray(b"v"))], model.MUTATION)
    with Store.open(spark, str(tmp_path / "b")) as s:
        for n in (0, 1, 2, 1, 2):
            s.write_frame(row(b"%d" % n), f"feed/{n}")
        s.write_frame(row(b"x"), "other/0")
        s.write_frame(row(b"y"), "plain")
        s.write_frame(row(b"z"), "plain")
        assert s.last_sequence == 5 and s._state.batches == {"feed/": 2, "other/": 0, "plain": 5}
        assert sorted(k for k, _ in view(s.scan())) == [b"0", b"1", b"2", b"x", b"y"]
