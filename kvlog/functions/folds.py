"""Ordered folds whose running totals restart when a limit trips; no window function expresses them.

A fold is a callable that takes the next row's values and returns the number of the row's part.  For tables, the rows
of each store are sorted inside one partition and pass through its fold batch by batch, so memory does not grow with
the store; a store's fold is sequential by definition, the stores of a table run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..model import BATCH_OPS

# Bytes of a block beside the keys and values of its entries.
ENTRY_FIXED_BYTES = 21
RESTART_BYTES = 4
BLOCK_TRAILER_BYTES = 8


class GroupPacker:
    """Writes of (bytes, operations), first in first out, to groups: a group ends before a write that would take it
    above a limit, and once its bytes are used up; a write above a limit has a group of its own."""

    def __init__(self, most_writes: int = 8, most_bytes: int = 1 << 20, most_operations: int = BATCH_OPS):
        self.limits = (most_writes, most_bytes, most_operations)
        self.number, self.totals = 0, (0, 0, 0)

    def __call__(self, size: int, operations: int = 1) -> int:
        used = tuple(t + x for t, x in zip(self.totals, (1, max(size, 1), operations)))
        if self.totals[0] and any(u > most for u, most in zip(used, self.limits)):
            self.number, self.totals = self.number + 1, (0, 0, 0)
        self.totals = tuple(t + x for t, x in zip(self.totals, (1, size, operations)))
        return self.number


class Rotation:
    """Entries of (bytes, write group) to generations of the memory table: one that has reached its limit is sealed
    when the next group begins."""

    def __init__(self, memtable_bytes: int):
        self.limit, self.number, self.held, self.group = memtable_bytes, 0, 0, None

    def __call__(self, size: int, group: int) -> int:
        if group != self.group and self.held >= self.limit:
            self.number, self.held = self.number + 1, 0
        self.group = group
        self.held += size
        return self.number


class BlockCutter:
    """Entries of (key, value bytes) to blocks: a new key starts a block if the block with it would be too large."""

    def __init__(self, block_bytes: int):
        self.limit, self.number, self.content, self.entries, self.key = block_bytes, 0, 0, 0, None

    def __call__(self, key, value: int) -> int:
        length = len(key) if isinstance(key, bytes) else len(str(key).encode())
        own = ENTRY_FIXED_BYTES + length + value
        size = self.content + own + RESTART_BYTES * (self.entries + 1) + BLOCK_TRAILER_BYTES
        if self.entries and key != self.key and size > self.limit:
            self.number, self.content, self.entries = self.number + 1, 0, 0
        self.key = key
        self.content += own
        self.entries += 1
        return self.number


def pack_groups(sizes: list[int], max_requests: int = 8, max_bytes: int = 1 << 20) -> list[int]:
    return list(map(GroupPacker(max_requests, max_bytes), sizes))


def rotate(sizes: list[int], groups: list[int], memtable_bytes: int) -> list[int]:
    return list(map(Rotation(memtable_bytes), sizes, groups))


def cut_blocks(entries: list[tuple[bytes, int]], block_bytes: int) -> list[int]:
    cut = BlockCutter(block_bytes)
    return [cut(key, value) for key, value in entries]


def assign(df: DataFrame, store: str, order: list[str], columns: list[str], fold: Callable[[], Callable[..., int]], name: str) -> DataFrame:
    """``df`` plus column ``name``: what a ``fold()`` of its own gives for the rows of each store in order."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches):
        current, step = object(), None
        for batch in batches:
            out = []
            for own, *values in zip(*[batch.column(c).to_pylist() for c in (store, *columns)]):
                if step is None or own != current:
                    current, step = own, fold()
                out.append(step(*values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, name])

    return df.repartition(store).sortWithinPartitions(store, *order).mapInArrow(run, schema)
