"""Sorted table files as a source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.formats import decode_table

ENTRIES = "file string, block long, user_key binary, seq long, tombstone boolean, value binary"
BLOCKS = "file string, block long, first_key binary, last_key binary, offset long, size long, entries long"
_ENTRIES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("user_key", pa.binary()), ("seq", pa.int64()), ("tombstone", pa.bool_()), ("value", pa.binary())])
_BLOCKS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("offset", pa.int64()), ("size", pa.int64()), ("entries", pa.int64())])


def _entries(name: str, data: bytes):
    """Rows of a table file, each with the number of its block, in internal order."""
    found, refs, _ = decode_table(data)
    at = 0
    for e in found:
        while e.key > refs[at].last:
            at += 1
        yield {"file": name, "block": at, "user_key": e.key, "seq": e.seq, "tombstone": e.tombstone, "value": None if e.tombstone else e.value}


def _blocks(name: str, data: bytes):
    count: dict[int, int] = {}
    for row in _entries(name, data):
        count[row["block"]] = count.get(row["block"], 0) + 1
    for n, ref in enumerate(decode_table(data)[1]):
        yield {"file": name, "block": n, "first_key": ref.first, "last_key": ref.last, "offset": ref.offset, "size": ref.size, "entries": count.get(n, 0)}


def _decoded(files: DataFrame, rows, schema: pa.Schema, sql: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                yield pa.RecordBatch.from_pylist(list(rows(name, data)), schema=schema)

    return files.select("path", "content").mapInArrow(run, sql)


def decode_tables(files: DataFrame) -> DataFrame:
    """Entries of table files given as (path, content); a file is decoded and checked by one task."""
    return _decoded(files, _entries, _ENTRIES, ENTRIES)


def inspect_tables(files: DataFrame) -> DataFrame:
    """Blocks of table files given as (path, content): key range, place and entries of each."""
    return _decoded(files, _blocks, _BLOCKS, BLOCKS)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all table files under ``path``, on any store."""
    return decode_tables(spark.read.format("binaryFile").load(path))
