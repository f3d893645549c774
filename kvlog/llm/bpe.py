"""Byte-level BPE encoding and decoding by monoid tree reduction.

A piece (one match of the split pattern) is halved recursively down to tokens or two bytes; the encodings of two
halves are joined where they meet.  The join rests on one fact about rank-ordered BPE over a closed vocabulary, one
whose every token is made by its own merges: a token sequence is the encoding of its bytes exactly if every two
neighbours are the encoding of their own bytes.  So a join looks at the two tokens at the seam.  If they are such a
pair, the halves are concatenated as they are.  If not, a window that grows by a token on each side is encoded anew
until its outermost tokens again form such pairs with the tokens outside; those outside are then proven final.
Joining is associative with the empty sequence as identity, hence a monoid.  ``closed`` checks the premise once a
vocabulary, on the driver; a vocabulary that fails is refused.

Decoding maps ids to bytes and concatenates neighbours up the tree.  Pieces repeat, so encodings of pieces and verdicts
on pairs are kept in tables of bounded size, two generations each.

Defined results: null and empty text have no tokens and the digests of nothing; bytes that are not UTF-8 are read as
U+FFFD; texts equal in bytes give equal ids, and repeated rows or ids one row each; a null doc_id stays null; one very
long piece costs O(n log n); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import frugal, strings

#: Windows up to this size are encoded by the definition.
WINDOW = 96
#: Entries of one generation of a table.
KEPT_PIECES = 200_000
KEPT_PAIRS = 150_000
KEPT_HALVES = 50_000
#: Halves up to this size (the longer one has a byte more) are kept.
HALF_BYTES = 8
#: The longest piece (characters) whose encoding is kept.
KEPT_BYTES = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.longest = max(map(len, self.bytes))
        self._pairs = _Kept(self._pair, KEPT_PAIRS)
        self._packed = _Kept(self._encoded, KEPT_PIECES)
        self._halves = _Kept(self.encode_piece, KEPT_HALVES)
        self.joins = 0

    def merge(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        whole = self.ranks.get(piece)
        return self._merges(piece) if whole is None else [whole]

    def _merges(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        near = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while near and (low := min(near)) < 1 << 60:
            i = near.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def closed(self) -> bool:
        """Whether every token is what its own bytes merge to."""
        return all(self._merges(token) == [rank] for token, rank in self.ranks.items())

    def pair(self, a: int, b: int) -> bool:
        """Whether tokens a and b are the encoding of their own bytes."""
        return self._pairs[a << 32 | b] is True

    def _pair(self, key: int) -> bool | list[int]:
        """True, or else the encoding of the bytes of both tokens."""
        a, b = key >> 32, key & 0xFFFFFFFF
        own = self.merge(self.bytes[a] + self.bytes[b])
        return own == [a, b] or own

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """The monoid's operation: the encoding of the bytes of x followed by those of y."""
        self.joins += 1
        if not x or not y:
            return x + y
        middle = self._pairs[x[-1] << 32 | y[0]]
        if middle is True:
            return x + y
        i, j = len(x) - 1, 1
        while True:
            left = i == 0 or self.pair(x[i - 1], middle[0])
            right = j == len(y) or self.pair(middle[-1], y[j])
            if left and right:
                return x[:i] + middle + y[j:]
            # twice as many tokens on the side that has not settled, so that a long ripple costs its own length
            i = i if left else max(0, i - (len(x) - i))
            j = j if right else min(len(y), 2 * j)
            middle = self._fold(b"".join([self.bytes[t] for t in x[i:] + y[:j]]))

    def _fold(self, piece: bytes) -> list[int]:
        """A window is short almost always; a long one is reduced like any piece, but from its left end."""
        if len(piece) <= WINDOW:
            return self.merge(piece)
        return self._left(piece)

    def _left(self, piece: bytes) -> list[int]:
        """Shortest-prefix programme: the last token of each prefix's encoding; used on long windows only, it needs
        no join and so ends the recursion."""
        last: list[int] = []
        for end in range(1, len(piece) + 1):
            for size in range(min(end, self.longest), 0, -1):
                token = self.ranks.get(piece[end - size : end])
                if token is not None and (size == end or self.pair(last[end - size - 1], token)):
                    last.append(token)
                    break
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[last[end - 1]])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) < 3:  # two bytes that are no token, or none
            return list(map(self.ranks.__getitem__, (piece[:1], piece[1:]))) if piece else []
        half = len(piece) // 2
        encode = self._halves.__getitem__ if half <= HALF_BYTES else self.encode_piece
        return self.join(encode(piece[:half]), encode(piece[half:]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self._packed.__getitem__, self.split.findall(text)))

    def _encoded(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece.encode()), "<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the tokens, neighbours concatenated level by level."""
        parts = [self.bytes[i] for i in ids]
        while len(parts) > 1:
            last = parts[-1:] if len(parts) % 2 else []
            parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + last
        return parts[0] if parts else b""


class _Kept(dict):
    """A function's results; what was not used for a whole generation goes.  Long keys are not kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if isinstance(key, str) and len(key) > KEPT_BYTES:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(maxsize=2)
def _bpe(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


@lru_cache(maxsize=8)
def _check(path: str) -> None:
    if not Bpe(read_ranks(path), "").closed():
        raise ValueError(f"{path}: not every token is made by its own merges")


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids: array<int>); each executor reads the vocabulary from
    ``path``, once a worker.  Rows are independent: nothing is shuffled."""
    _check(path)

    @frugal
    def run(batches):
        bpe = _bpe(path, pattern)
        for batch in batches:
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for text in strings(batch.column("text")):
                packed = bpe.encode_packed(text or "")
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
