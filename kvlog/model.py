"""Data model: schemas, options and errors of a multi-version change log."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("user_key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
MUTATION = T.StructType(
    [
        T.StructField("ordinal", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
VIEW = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType(), False)])
RUNS = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("file_number", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("smallest_key", T.BinaryType()),
        T.StructField("largest_key", T.BinaryType()),
        T.StructField("min_sequence", T.LongType()),
        T.StructField("max_sequence", T.LongType()),
    ]
)
MAX_SEQUENCE = 2**63 - 1
BATCH_OPS = 1_000_000
BATCH_BYTES = 128 << 20


class StatusError(Exception):
    """One subclass a status code; OK has none."""

    code = "Unknown"


class NotFound(StatusError):
    code = "NotFound"


class InvalidArgument(StatusError):
    code = "InvalidArgument"


class IOFailure(StatusError):
    code = "IOError"


class Corruption(StatusError):
    code = "Corruption"


class Closed(StatusError):
    code = "Closed"


class ResourceExhausted(StatusError):
    code = "ResourceExhausted"


class NotSupported(StatusError):
    code = "NotSupported"


@dataclass(frozen=True)
class Options:
    memtable_bytes: int = 4 << 20
    create_if_missing: bool = True
    sync_on_write: bool = True
    max_key_bytes: int = 4 << 20
    max_value_bytes: int = 64 << 20
    sstable_block_bytes: int = 16 << 10
    sstable_restart_interval: int = 16
    block_cache_bytes: int = 8 << 20
    compaction_table_trigger: int = 4
    max_active_snapshots: int = 1024
    max_pending_write_requests: int = 64
    max_pending_write_bytes: int = 8 << 20
    max_group_commit_requests: int = 8
    max_group_commit_bytes: int = 1 << 20
    #: Fixed part of an entry's size in memory; the value is that of a 64-bit build and only moves flush points.
    entry_overhead_bytes: int = 56
    validate_on_open: bool = False
    #: An opener that has not committed for so long may be taken for dead.
    lease_seconds: int = 3600

    def __post_init__(self):
        may_be_zero = {"block_cache_bytes", "compaction_table_trigger", "max_active_snapshots", "entry_overhead_bytes"}
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, bool):
                continue
            if v < 0 or (v == 0 and f.name not in may_be_zero):
                raise InvalidArgument(f"{f.name} must be positive")
        if self.compaction_table_trigger == 1:
            raise InvalidArgument("compaction_table_trigger must be 0 or at least 2")


def check_range(begin: bytes, end: bytes) -> None:
    """An empty end has no bound; otherwise it must not precede begin."""
    if end and end < begin:
        raise InvalidArgument("end precedes begin")
