"""Binary change-log files as a batch source: ``spark.read.format("kvwal").load(path)``."""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.formats import Entry, decode_log, encode_batch
from ..model import Corruption

SCHEMA = "file string, record long, user_key binary, seq long, tombstone boolean, value binary"
_ARROW = pa.schema([("file", pa.string()), ("record", pa.int64()), ("user_key", pa.binary()), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary())])


def _rows(name: str, data: bytes, floor: int = 0):
    for number, e in decode_log(data, floor)[0]:
        yield name, number, e.key, e.seq, e.tombstone, None if e.tombstone else e.value


def decode_wal(files: DataFrame, floor: int = 0) -> DataFrame:
    """One row per entry of log files given as (path, content); a file is decoded by one task."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                columns = list(zip(*_rows(name, data, floor)))
                if columns:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _ARROW)], schema=_ARROW)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def recover_wal(files: DataFrame, floor: int = 0) -> DataFrame:
    """What a recovery finds in each log file given as (path, content): entries, max_sequence, valid_bytes,
    truncated_tail (an incomplete last record is left out), and error (null, or what makes the file corrupt)."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found, used = decode_log(data, floor)
                    rows.append({"path": name, "entries": len(found), "max_sequence": found[-1][1].seq if found else None, "valid_bytes": used, "truncated_tail": used < len(data), "error": None})
                except Corruption as e:
                    rows.append({"path": name, "error": str(e)})
            schema = pa.schema([("path", pa.string()), ("entries", pa.int64()), ("max_sequence", pa.int64()), ("valid_bytes", pa.int64()), ("truncated_tail", pa.bool_()), ("error", pa.string())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, entries long, max_sequence long, valid_bytes long, truncated_tail boolean, error string")


def read_wal(spark: SparkSession, path: str, floor: int = 0) -> DataFrame:
    """One row per entry of all files under ``path``, on any store."""
    return decode_wal(spark.read.format("binaryFile").load(path), floor)


class WalSource(DataSource):
    """``path`` is a file, a folder or a pattern; option ``floor`` is the sequence that all entries must exceed."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WalWriter(self.options["path"], overwrite, int(self.options.get("batch", 1000)))

    def reader(self, schema) -> DataSourceReader:
        return WalReader(self.options["path"], int(self.options.get("floor", 0)))


class WalReader(DataSourceReader):
    """Reads files that every executor sees by one path, one partition each; ``read_wal`` reads from any store."""

    def __init__(self, path: str, floor: int = 0):
        self.path, self.floor = path.removeprefix("file://"), floor

    def partitions(self):
        found = glob.glob(os.path.join(self.path, "*.wal") if os.path.isdir(self.path) else self.path)
        if not found:
            raise FileNotFoundError(self.path)
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from _rows(partition.value, f.read(), self.floor)


@dataclass
class Written(WriterCommitMessage):
    temporary: list[str]


class WalWriter(DataSourceWriter):
    """Appends log files to a folder that every executor sees by one path.  Each task writes its rows, in order of
    seq, as batch records of consecutive sequences to a temporary file and syncs it; the commit renames them all, in
    the order of their first sequence, to the next numbers of the folder."""

    def __init__(self, path: str, overwrite: bool, batch: int):
        self.path, self.overwrite, self.batch = path.removeprefix("file://"), overwrite, batch

    def write(self, rows) -> Written:
        found = sorted((Entry(bytes(r["user_key"]), r["seq"], r["tombstone"], bytes(r["value"] or b"")) for r in rows), key=lambda e: e.seq)
        if not found:
            return Written([])
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"{found[0].seq:020d}-{uuid.uuid4().hex}.tmp")
        with open(name, "wb") as f:
            held: list[Entry] = []
            for e in [*found, None]:
                if held and (e is None or len(held) == self.batch or e.seq != held[-1].seq + 1):
                    f.write(encode_batch(held))
                    held = []
                if e is not None:
                    held.append(e)
            f.flush()
            os.fsync(f.fileno())
        return Written([name])

    def commit(self, messages) -> None:
        old = glob.glob(os.path.join(self.path, "*.wal"))
        if self.overwrite:
            for name in old:
                os.remove(name)
            old = []
        number = max([int(n) for p in old if (n := os.path.basename(p).removesuffix(".wal")).isdigit()], default=0)
        for name in sorted(n for m in messages if m for n in m.temporary):
            number += 1
            os.rename(name, os.path.join(self.path, f"{number:06d}.wal"))

    def abort(self, messages) -> None:
        for m in messages:
            for name in m.temporary if m else []:
                os.remove(name)
