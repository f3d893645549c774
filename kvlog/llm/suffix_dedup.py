"""Removal of long byte strings that an earlier document holds, by sharded suffix arrays.

A byte goes if a 50-byte string (a window) that covers it also starts in a document with a smaller doc_id.

Sharding.  Each window has a fingerprint: the smallest hash among its 20-byte substrings.  It depends on the
window's bytes alone, so equal windows have equal fingerprints, and neighbouring windows mostly share theirs: a run
of windows with one fingerprint is a *segment*.  Documents are dealt once to groups by a hash of their id; all
steps reuse that one exchange:

1. each group lists its fingerprints; buckets of fingerprints find those of two or more documents;
2. each group names its segments under these, every distinct one once with its smallest doc_id.  A bucket picks, for
   each distinct segment, the group of the smallest doc_id: that one sends the bytes to the shard of the fingerprint,
   the others only their claim (digest and smallest doc_id).  A fingerprint of very many documents is salted over
   several shards, and every group sends its segments there;
3. each shard builds a suffix array (Larsson-Sadakane refinement, up to the window length) of all its segments,
   common prefixes (Kasai, all segments in step) and from them the classes of equal windows with their smallest
   doc_id.  Salted shards then merge their sorted class lists by binary search;
4. each group marks windows that have a smaller doc_id than their own document and cuts the bytes.  Copies of a
   segment inside a group share the answer of the first one.

Memory: a group holds GROUP_BYTES of text (or one longer document), a shard about SHARD_BYTES of segments.  Rows
between steps are packed arrays, one per (group, bucket), so a frequent string costs one entry a group.

Defined results: null text is empty bytes; texts under 50 bytes lose nothing; equal texts: all but those with the
smallest doc_id lose everything; rows that share a doc_id never remove each other's bytes; a null doc_id counts as
the largest; an empty table gives an empty table; extra columns are ignored.
"""


import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import give_back

WINDOW = 50
GRAM = 20
GROUP_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
CHUNK = 1 << 18
#: No segment has more windows, so that its first and last window cover it and a 32-bit mask describes it.
RUN = 32
#: Fingerprints of more than 2 ** HOT documents or so are salted.
HOT = 9
#: Windows of salted shards are merged in at least so many buckets, and more as the data grow.
MERGE_LEAST = 256
_BIG = np.iinfo(np.int64).max
_U = np.uint64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MASK64 = (1 << 64) - 1


_ROUTE = pa.schema([("kind", pa.string()), ("to", pa.int32()), ("e", pa.binary()), ("d", pa.binary()), ("m", pa.binary()), ("g", pa.binary())])
_ROUTE_SQL = "kind string, to int, e binary, d binary, m binary, g binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _rolling(b: np.ndarray, base: int, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Polynomial hashes of all substrings of the given lengths, by doubling."""
    at = {1: b.astype(np.uint64) + _U(1)}
    for length in lengths:
        _extend(at, len(b), base, length)
    return {n: at[n] for n in lengths}


def _extend(at: dict[int, np.ndarray], size: int, base: int, n: int) -> np.ndarray:
    if n not in at:
        left = 1 << ((n - 1).bit_length() - 1)
        x, y = _extend(at, size, base, left), _extend(at, size, base, n - left)
        m = max(0, size - n + 1)
        at[n] = x[:m] * _U(pow(base, n - left, 1 << 64)) + y[left : left + m]
    return at[n]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x = np.minimum(x[: len(x) - w], x[w:])
        w *= 2
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def _segments(b: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Segments of the texts b[starts[k]:ends[k]]: first window, number of windows, text, fingerprint, digest."""
    found = [[np.empty(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)]
    k, n = 0, len(starts)
    while k < n:
        lo, first = int(starts[k]), k
        while k < n and ends[k] - lo <= CHUNK:
            k += 1
        spans = [(lo, int(ends[k - 1]), first, k)] if k > first else []
        if k == first:  # one long text: its windows in chunks
            spans = [(c, min(int(ends[k]), c + CHUNK + WINDOW - 1), k, k + 1) for c in range(lo, max(lo + 1, int(ends[k]) - WINDOW + 1), CHUNK)]
            k += 1
        for s, e, p, q in spans:
            if e - s < WINDOW:
                continue
            h = _rolling(b[s:e], _B1, (GRAM, WINDOW))
            f = _sliding_min(_mix(h[GRAM]), WINDOW - GRAM + 1)
            ok = np.zeros(len(f) + 1, np.int8)
            own_s, own_e = np.maximum(starts[p:q], s) - s, np.minimum(ends[p:q], e) - s - WINDOW + 1
            has = own_e > own_s
            np.add.at(ok, own_s[has], 1)
            np.add.at(ok, own_e[has], -1)
            w = np.flatnonzero(np.cumsum(ok[:-1], dtype=np.int8))
            if not len(w):
                continue
            fw = f[w]
            cut = np.flatnonzero(np.concatenate(([True], (fw[1:] != fw[:-1]) | (w[1:] != w[:-1] + 1))))
            size = np.diff(np.append(cut, len(w)))
            if size.max() > RUN:
                parts = (size + RUN - 1) // RUN
                rep = np.repeat(np.arange(len(cut)), parts)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
                cut, size = cut[rep] + nth * RUN, np.minimum(RUN, size[rep] - nth * RUN)
            i = w[cut]
            d = _mix(_mix(h[WINDOW][i]) + h[WINDOW][i + size - 1] * _U(3) + size.astype(np.uint64))
            text = np.searchsorted(starts[p:q], i + s, "right") - 1 + p
            for out, x in zip(found, (i + s, size, text, fw[cut], d)):
                out.append(x)
    i, size, text, f, d = (np.concatenate(x) for x in found)
    # a smallest hash is small; mixed again, fingerprints spread evenly over buckets
    return i, size, text, _mix(f) & ~_U(15), d


class _Group:
    """The texts of one group as one byte array in the order of their ids, with their segments."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").fill_null(_BIG).to_numpy().astype(np.int64) if table.num_rows else np.empty(0, np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids, self.table = ids[order], table.take(pa.array(order)) if len(order) else table
        texts = [x or b"" for x in self.table.column("body").to_pylist()]
        size = np.array([len(x) for x in texts], np.int64)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.i, self.n, self.text, self.f, self.d = _segments(self.bytes, self.starts, self.ends)
        self.id = self.ids[self.text] if len(self.text) else np.empty(0, np.int64)

    def distinct(self, among: np.ndarray):
        """Of the segments in ``among`` (ascending): their order by (fingerprint, digest, id), and the places where a
        new (fingerprint, digest) begins."""
        order = among[np.lexsort((self.d[among], self.f[among]))]  # stable, and segments lie in the order of ids
        return order, _starts(self.f[order], self.d[order])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], np.any([x[1:] != x[:-1] for x in columns], axis=0))))


def _among(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in the sorted ``values``, -1 where absent."""
    if not len(values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return np.where(values[at] == x, at, -1)


@lru_cache(maxsize=1)
def _codecs():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _small(raw: bytes) -> bytes:
    """Compressed, if that helps; the first byte says so."""
    packed = _codecs()[0].compress(raw) if len(raw) > 32 else raw
    return b"\1" + packed if len(packed) < len(raw) else b"\0" + raw


def _large(x: bytes) -> bytes:
    return _codecs()[1].decompress(x[1:]) if x[0] else x[1:]


def _planes(x: np.ndarray) -> bytes:
    """The array byte by byte: all first bytes, then all second ones; equal bytes come together, which makes it small."""
    return _small(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _unpacked(rows: list[bytes | None], kind) -> np.ndarray:
    """What ``_planes`` made of arrays, laid end to end."""
    width = np.dtype(kind).itemsize
    parts = [np.frombuffer(_large(x), np.uint8).reshape(width, -1).T for x in rows if x]
    return np.ascontiguousarray(np.concatenate(parts)).view(kind).ravel() if parts else np.empty(0, kind)


def _packed(keys: np.ndarray, parts: int, columns: list[np.ndarray]):
    """Rows of binary columns, one per key that occurs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    ends = np.append(cut[1:], len(k))
    rows = [[_planes(x[order[a:b]]) for a, b in zip(cut, ends)] for x in columns]
    return k[cut].astype(np.int32), rows


def _short(f: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of a fingerprint (its first ``bits`` bits) and 36 bits more."""
    return f >> _U(28 - bits)


def _list_fingerprints(bits: int):
    """Bucket rows of 36 further bits of each fingerprint and 4 for the log2 of its documents.  Fingerprints that
    agree in these bits only are called shared without harm: their segments find no equal ones."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        g = _Group(table)
        order = np.argsort(g.f, kind="stable")
        f, ids = g.f[order], g.id[order]
        new_f = _starts(f)
        new_id = np.concatenate(([True], (f[1:] != f[:-1]) | (ids[1:] != ids[:-1]))).astype(np.int64) if len(f) else np.empty(0, np.int64)
        docs = np.add.reduceat(new_id, new_f) if len(f) else new_id
        level = np.minimum(15, np.ceil(np.log2(np.maximum(1, docs)))).astype(np.uint64)
        x = _short(f[new_f], bits)
        tail = ((x << _U(4)) | level).astype("<u8")
        tail = tail.view(np.uint8).reshape(-1, 8)[:, :5] if len(tail) else np.empty((0, 5), np.uint8)
        bucket = (x >> _U(36)).astype(np.int64)
        cut = _starts(bucket)
        rows = [_small(tail[p:q].T.tobytes()) for p, q in zip(cut, np.append(cut[1:], len(x)))]
        return pa.table({"bucket": pa.array(bucket[cut].astype(np.int32)), "g": pa.array(np.full(len(cut), key[0].as_py(), np.int32)), "f": pa.array(rows, pa.binary())})

    return run


def _shared_fingerprints(table: pa.Table) -> pa.Table:
    """Back to each group: its fingerprints, shortened, that two or more documents hold, with the rounded log2 of how
    many."""
    raw = [np.frombuffer(_large(x), np.uint8).reshape(5, -1).T for x in table.column("f").to_pylist()]
    bucket = np.repeat(table.column("bucket").to_numpy().astype(np.uint64), list(map(len, raw)))
    g = np.repeat(table.column("g").to_numpy(), list(map(len, raw)))
    x = np.zeros((len(g), 8), np.uint8)
    x[:, :5] = np.concatenate(raw)
    x = x.view("<u8").ravel().astype(np.uint64)
    f, docs = (bucket << _U(36)) | (x >> _U(4)), np.left_shift(1, (x & _U(15)).astype(np.int64))
    order = np.argsort(f, kind="stable")
    f, g, docs = f[order], g[order], docs[order]
    new = _starts(f)
    count = np.diff(np.append(new, len(f)))
    total = np.add.reduceat(docs, new)
    level = np.repeat(np.minimum(63, np.ceil(np.log2(total))).astype(np.uint8), count)
    keep = np.repeat(total > 1, count)
    groups, (rows, levels) = _packed(g[keep].astype(np.int64), 0, [f[keep], level[keep]])
    return pa.table({"g": pa.array(groups), "f": pa.array(rows, pa.binary()), "level": pa.array(levels, pa.binary())})


def _pick(g: _Group, own: np.ndarray, f: np.ndarray, level: np.ndarray):
    """The first segment of each (fingerprint, digest) of the group whose ``own`` value is listed in f, and its
    level."""
    order = np.argsort(f, kind="stable")
    f, level = f[order], level[order]
    at = _among(f, own)
    by, new = g.distinct(np.flatnonzero(at >= 0))
    return by[new], level[at[by[new]]].astype(np.int64)


def _listed(table: pa.Table, fs: str, levels: str) -> tuple[np.ndarray, np.ndarray]:
    return _unpacked(table.column(fs).to_pylist(), np.uint64), _unpacked(table.column(levels).to_pylist(), np.uint8)


def _tag(f: np.ndarray) -> np.ndarray:
    """16 bits of the fingerprint: with the digest they name a segment inside its shard, in 80 bits."""
    return (f >> _U(8)).astype(np.uint16)


_HEADS_SQL = "bucket int, g int, sub binary, e binary, d binary, id binary, hot binary, level binary"


def _head_segments(bits: int, spread: int):
    """Names and smallest ids of segments, without their bytes, and the shard inside the bucket; of a frequent
    fingerprint only itself and its level."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, shared: pa.Table) -> pa.Table:
        g = _Group(texts)
        first, lv = _pick(g, _short(g.f, bits), *_listed(shared, "f", "level"))
        hot = lv > HOT
        place = _mix(g.f[first]) >> _U(64 - bits - spread)
        bucket = (place >> _U(spread)).astype(np.int64)
        x = first[~hot]
        keys, rows = _packed(bucket[~hot], 0, [(place[~hot] & _U((1 << spread) - 1)).astype(np.uint16), _tag(g.f[x]), g.d[x], g.id[x]])
        x = np.flatnonzero(hot)[_starts(g.f[first[hot]])]  # first is sorted by fingerprint
        hots, names = _packed(bucket[x], 0, [g.f[first[x]], lv[x].astype(np.uint8)])
        out = [{"bucket": int(k), "sub": p, "e": q, "d": r, "id": t} for k, p, q, r, t in zip(keys, *rows)]
        out += [{"bucket": int(k), "hot": p, "level": q} for k, p, q in zip(hots, names[0], names[1])]
        schema = pa.schema([("bucket", pa.int32()), ("g", pa.int32())] + [(c, pa.binary()) for c in ("sub", "e", "d", "id", "hot", "level")])
        return pa.Table.from_pylist([r | {"g": key[0].as_py()} for r in out], schema=schema)

    return run


def _resolve(spread: int):
    """Who sends which segment.  Of each distinct segment the group with its smallest id is told to send the bytes
    ("ship", half the digest in d: a segment more does no harm); claims of the other groups go to the shard at once
    ("claim", id in m).  A frequent fingerprint is sent by every group that has it ("all")."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = []
        for row in table.filter(pa.compute.is_valid(table.column("hot"))).to_pylist():
            out.append({"kind": "all", "to": row["g"], "e": row["hot"], "d": row["level"]})
        table = table.filter(pa.compute.is_valid(table.column("id")))
        many = [_unpacked([x], np.int64) for x in table.column("id").to_pylist()]
        ids = np.concatenate(many) if many else np.empty(0, np.int64)
        g = np.repeat(table.column("g").to_numpy(), list(map(len, many)))
        sub, e, d = (_unpacked(table.column(c).to_pylist(), t) for c, t in (("sub", np.uint16), ("e", np.uint16), ("d", np.uint64)))
        order = np.lexsort((g, ids, d, e, sub))
        sub, e, d, ids, g = (x[order] for x in (sub, e, d, ids, g))
        least = np.zeros(len(d), bool)
        least[_starts(sub, e, d)] = True
        groups, (ds,) = _packed(g[least].astype(np.int64), 0, [(d[least] >> _U(32)).astype(np.uint32)])
        out += [{"kind": "ship", "to": int(k), "d": y} for k, y in zip(groups, ds)]
        sub, e, d, ids, g = (x[~least] for x in (sub, e, d, ids, g))
        groups, rows = _packed((key[0].as_py() << spread) + sub.astype(np.int64), 0, [e, d, ids, g.astype(np.int32)])
        out += [{"kind": "claim", "to": int(k), "e": x, "d": y, "m": z, "g": w} for k, x, y, z, w in zip(groups, *rows)]
        return pa.Table.from_pylist(out, schema=_ROUTE)

    return run


def _ship_segments(shard_bits: int):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, news: pa.Table) -> pa.Table:
        g = _Group(texts)
        f, lv = _listed(_of_kind(news, "all"), "e", "d")
        order = np.argsort(f, kind="stable")
        f, lv = f[order], lv[order].astype(np.int64)
        names = np.sort(_unpacked(_of_kind(news, "ship").column("d").to_pylist(), np.uint32))
        at = _among(f, g.f)
        by, new = g.distinct(np.flatnonzero((at >= 0) | (_among(names, (g.d >> _U(32)).astype(np.uint32)) >= 0)))
        first = by[new]
        lv = np.append(lv, 0)[at[first]]
        hot = lv > 0
        salt = g.d[first] & ((_U(1) << np.maximum(0, lv - HOT).astype(np.uint64)) - _U(1))
        shard = 2 * (_mix(g.f[first] + salt) >> _U(64 - shard_bits)).astype(np.int64) + hot
        size = (g.n[first] + WINDOW - 1).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        first, size = first[order], size[order]
        keys, rows = _packed(shard[order], 0, [_tag(g.f[first]), g.d[first], g.id[first], size.astype(np.uint8)])
        count = np.diff(np.append(_starts(shard[order]), len(order)))
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(g.i[first], size)
        data, cut = g.bytes[place].tobytes(), np.append(0, ends[np.cumsum(count) - 1]) if len(count) else []
        bodies = [_small(data[a:b]) for a, b in zip(cut, cut[1:])]
        own = [_planes(np.full(n, key[0].as_py(), np.int32)) for n in count]
        b = pa.binary()
        return pa.table({"shard": pa.array(keys >> 1), "salted": pa.array((keys & 1).astype(bool)), "g": pa.array(own, b)} | {c: pa.array(x, b) for c, x in zip(("e", "d", "id", "size"), rows)} | {"body": pa.array(bodies, b)})

    return run


def suffix_array(b: np.ndarray, rest: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of byte strings laid end to end, sorted by their first ``depth`` bytes, and each one's place.

    ``rest[i]`` is the number of bytes from i to the end of its own string.  Larsson-Sadakane: suffixes are grouped
    by their first h bytes; a group's number is the place of its first member; groups of one are finished, the others
    are sorted by the group of the suffix h bytes on, which doubles h.  Equal suffixes stay in order of their places,
    on which Kasai's rule relies.
    """
    n = len(b)
    padded = np.append(b, np.zeros(8, np.uint8))
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    # the first seven bytes, none beyond the string, and how many they are
    known = np.minimum(rest, 7)
    key &= np.array([_MASK64 ^ (_MASK64 >> 8 * k) for k in range(8)], np.uint64)[known]
    key |= known.astype(np.uint64)
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 7
    while h < depth and len(slots):
        own = sa[slots]
        nxt = np.where(rest[own] > h, rank[np.minimum(own + h, n - 1)] + 1, 0)
        key = (rank[own] << 32) | nxt
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[slots] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = slots[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    tied = sa[slots]
    sa[slots] = tied[np.argsort((rank[tied] << 32) | tied)]
    where = np.empty(n, np.int64)
    where[sa] = np.arange(n)
    return sa, where


def common_prefixes(b: np.ndarray, rest: np.ndarray, starts: np.ndarray, sa: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Kasai: the prefix that each suffix shares with the one before it in the array.  All
    strings advance in step: from a suffix to the next one a common prefix loses one byte at most."""
    lcp = np.zeros(len(b), np.int64)
    length = np.zeros(len(starts), np.int64)
    last = rest[starts] if len(starts) else rest[:0]
    for t in range(int(last.max(initial=0))):
        live = np.flatnonzero(last > t)
        i = starts[live] + t
        p = where[i]
        j = sa[np.maximum(p - 1, 0)]
        most = np.where(p > 0, np.minimum(rest[i], rest[j]), 0)
        n = np.minimum(np.maximum(length[live] - 1, 0), most)
        go = np.flatnonzero(n < most)
        while len(go):
            go = go[b[i[go] + n[go]] == b[j[go] + n[go]]]
            n[go] += 1
            go = go[n[go] < most[go]]
        lcp[p] = n
        length[live] = n
    return lcp


def _classes(buckets: int, salted: bool):
    """The shard step, for salted fingerprints or the others.  Sends masks of repeated windows to groups; for salted
    fingerprints, windows to merge."""

    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.compute.equal(table.column("salted"), salted))
        return _shard(table, buckets, salted) if table.num_rows else pa.Table.from_pylist([], schema=_ROUTE)

    return run


def _shard(table: pa.Table, buckets: int, salted: bool) -> pa.Table:
    """Rows without sizes are claims, which have no bytes.  All rows are of salted fingerprints, or none."""
    e, d, ids, g = (_unpacked(table.column(c).to_pylist(), t) for c, t in (("e", np.uint16), ("d", np.uint64), ("id", np.int64), ("g", np.int32)))
    sizes = table.column("size").to_pylist()
    sent = np.concatenate([_unpacked([x], np.uint8).astype(np.int64) if x else np.zeros(len(_unpacked([y], np.uint16)), np.int64) for x, y in zip(sizes, table.column("e").to_pylist())])
    claim = sent == 0
    body = np.frombuffer(b"".join(_large(x) for x in table.column("body").to_pylist() if x), np.uint8)
    begin = np.cumsum(sent) - sent
    order = np.lexsort((claim, ids, d, e))  # one copy of each segment is enough; the smallest id has the bytes
    new = np.zeros(len(order), bool)
    new[_starts(e[order], d[order])] = True
    unit = np.empty(len(order), np.int64)
    unit[order] = np.cumsum(new) - 1
    first = order[new]
    least, n = ids[first], sent[first]
    size = n[unit]
    starts = np.cumsum(n) - n
    total = int(n.sum())
    own = np.repeat(np.arange(len(n)), n)
    off = np.arange(total) - starts[own]
    b, rest = body[begin[first][own] + off], n[own] - off
    sa, where = suffix_array(b, rest, int(n.max()))
    lcp = common_prefixes(b, rest, starts, sa, where)
    cls = np.cumsum(lcp < WINDOW) - 1
    head = np.flatnonzero(lcp < WINDOW)
    low = np.minimum.reduceat(least[own[sa]], head)
    low_at = low[cls[where]]  # by position: the smallest id of its class
    # groups' own segments: bit k is set if window k occurs under a smaller id
    count = size - WINDOW + 1
    ends = np.cumsum(count)
    nth = np.arange(ends[-1]) - np.repeat(ends - count, count)
    pos = np.repeat(starts[unit], count) + nth
    smaller = np.add.reduceat((low_at[pos] < np.repeat(ids, count)).astype(np.int64) << nth, ends - count)
    pick = np.flatnonzero(smaller)
    groups, rows = _packed(g[pick].astype(np.int64), 0, [e[pick], d[pick], smaller[pick].astype(np.uint32)])
    out = [{"kind": "mask", "to": int(k), "e": x, "d": y, "m": z} for k, x, y, z in zip(groups, *rows)]
    if salted:
        row = np.repeat(np.arange(len(e)), count)
        h1, h2 = (_mix(_rolling(b, base, (WINDOW,))[WINDOW][pos]) for base in (_B1, _B2))
        order = np.lexsort((g[row], h2, h1))
        h1, h2, low, to = h1[order], h2[order], low_at[pos][order], g[row][order]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (to[1:] != to[:-1])))
        h1, h2, low, to = h1[new], h2[new], low[new], to[new].astype(np.int64)
        keys, lists = _packed((h1 % _U(buckets)).astype(np.int64), buckets, [h1, h2, low, to])
        out += [{"kind": "window", "to": int(k), "e": x, "d": y, "m": z, "g": w} for k, x, y, z, w in zip(keys, *lists)]
    return pa.Table.from_pylist(out, schema=_ROUTE)


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Masks go on to their groups.  Sorted window lists of salted shards are merged: each list's windows are found
    in the union by binary search; a group hears of a window if another shard has it under a smaller id."""
    if key[0].as_py() == "mask":
        return table
    lists = [[_unpacked([x], t) for x in table.column(c).to_pylist()] for c, t in (("e", np.uint64), ("d", np.uint64), ("m", np.int64), ("g", np.int64))]
    h1, h2 = np.concatenate(lists[0]), np.concatenate(lists[1])
    order = np.lexsort((h2, h1))
    h1, h2 = h1[order], h2[order]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
    h1, h2 = h1[new], h2[new]
    least = np.full(len(h1), _BIG, np.int64)
    places = []
    for x, y, low, _ in zip(*lists):
        at = np.searchsorted(h1, x)
        while len(off := np.flatnonzero(h2[at] != y)):
            at[off] += 1
        np.minimum.at(least, at, low)
        places.append(at)
    told = [least[at] < low for at, low in zip(places, lists[2])]
    told = [np.concatenate([z[k] for z, k in zip(zs, told)]) for zs in (lists[0], lists[1], [least[at] for at in places], lists[3])]
    groups, rows = _packed(told[3], 0, told[:3])
    return pa.Table.from_pylist([{"kind": "low", "to": int(k), "e": p, "d": q, "m": r} for k, p, q, r in zip(groups, *rows)], schema=_ROUTE)


def _of_kind(table: pa.Table, kind: str) -> pa.Table:
    return table.filter(pa.compute.equal(table.column("kind"), kind)) if table.num_rows else table


def _route(table: pa.Table, kind: str, *kinds) -> list[np.ndarray]:
    t = _of_kind(table, kind)
    return [_unpacked(t.column(c).to_pylist(), d) for c, d in zip("edm", kinds)]


def _removed(g: _Group, news: pa.Table) -> np.ndarray:
    """By byte of the group: whether it goes."""
    size = len(g.bytes)
    begins, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def cover(windows: np.ndarray, length) -> None:
        begins.append(windows)
        ends.append(windows + length)

    if len(g.f):
        e, d, m = _route(news, "mask", np.uint16, np.uint64, np.uint32)
        by = np.lexsort((e, d))
        e, d, m = e[by], d[by], m[by].astype(np.int64)
        new = _starts(e, d)
        mask = np.bitwise_or.reduceat(m, new) if len(new) else m
        e, d = e[new], d[new]
        # segments that may lose something: told of by a shard, or with a copy in the group
        ranked = np.argsort(g.f, kind="stable")
        twin = g.f[ranked][1:] == g.f[ranked][:-1]
        maybe = np.zeros(len(g.f), bool)
        maybe[ranked] = np.append(False, twin) | np.append(twin, False)
        maybe |= _among(d[_starts(d)], g.d) >= 0
        order, new = g.distinct(np.flatnonzero(maybe))
        block = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
        first = order[new]
        later = g.id[order] > g.id[first][block]
        cover(g.i[order[later]], g.n[order[later]] + WINDOW - 1)
        # each mask goes to the segment of its name, by digest and then by tag
        told = np.zeros(len(first), np.int64)
        own_e = _tag(g.f[first])
        at = np.searchsorted(d, g.d[first])
        for step in range(int(np.diff(np.append(_starts(d), len(d))).max(initial=0))):
            p = np.minimum(at + step, len(d) - 1)
            hit = (d[p] == g.d[first]) & (e[p] == own_e)
            told[hit] = mask[p[hit]]
        own = np.where(later, 0, told[block])
        at, count = g.i[order], g.n[order]
        whole = (own != 0) & (own == np.left_shift(1, count) - 1)
        cover(at[whole], count[whole] + WINDOW - 1)
        part = np.flatnonzero((own != 0) & ~whole)
        for k in range(RUN):
            cover(at[part[(own[part] >> k) & 1 == 1]] + k, WINDOW)
        h1, h2, low = _route(news, "low", np.uint64, np.uint64, np.int64)
        if len(h1):
            by = np.lexsort((low, h2, h1))
            h1, h2, low = h1[by], h2[by], low[by]
            seen = np.zeros(1 << 20, bool)  # a first look that most windows fail
            seen[h1 >> _U(44)] = True
            for s in range(0, size - WINDOW + 1, CHUNK):
                part = g.bytes[s : s + CHUNK + WINDOW - 1]
                x1 = _mix(_rolling(part, _B1, (WINDOW,))[WINDOW])
                w = np.flatnonzero(seen[x1 >> _U(44)])
                at = np.searchsorted(h1, x1[w])
                hit = (at < len(h1)) & (h1[np.minimum(at, len(h1) - 1)] == x1[w])
                w, at = w[hit], at[hit]
                if not len(w):
                    continue
                x2 = _mix(_rolling(part, _B2, (WINDOW,))[WINDOW][w])
                text = np.searchsorted(g.starts, w + s, "right") - 1
                inside = (w + s + WINDOW <= g.ends[text]) & (h2[at] == x2) & (low[at] < g.ids[text])
                cover(w[inside] + s, WINDOW)
    step = np.bincount(np.concatenate(begins), minlength=size + 1) - np.bincount(np.concatenate(ends), minlength=size + 1)
    return np.cumsum(step[:-1]) > 0


def _cut(names: tuple[str, ...]):
    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, news: pa.Table) -> pa.Table:
        g = _Group(texts)
        gone = _removed(g, news)
        total = np.append(0, np.cumsum(gone))
        first = gone & ~np.append(False, gone[:-1])
        starts = g.starts[g.ends > g.starts]
        first[starts] = gone[starts]
        runs = np.append(0, np.cumsum(first))
        removed, spans = total[g.ends] - total[g.starts], runs[g.ends] - runs[g.starts]
        kept = [g.bytes[s:e].tobytes() if not r else g.bytes[s:e][~gone[s:e]].tobytes() for s, e, r in zip(g.starts, g.ends, removed)]
        out = {c: g.table.column(c) for c in names}
        out |= {"n_bytes": pa.array(g.ends - g.starts), "n_removed": pa.array(removed), "n_spans": pa.array(spans), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept])}
        if "row" in names:
            raw = g.table.column("body").to_pylist()
            left = [None if x is None else y if not r else y.decode("utf-8", "ignore").encode() for x, y, r in zip(raw, kept, removed)]
            out |= {"kept": pa.array(left, pa.binary()), "emptied": pa.array([bool(r) and not y.strip() and bool(x.strip()) for x, y, r in zip(raw, left, removed)])}
        give_back()
        return pa.table(out)

    return run


def remove_repeats(docs: DataFrame, keep_rows: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_rows`` also row (all columns of ``docs`` but text
    as a struct), kept (the bytes that stay, without parts of characters; null for a null text) and emptied (whether
    a text that was not blank is now)."""
    body = F.col("text").cast("string").cast("binary")
    fields = [F.col("doc_id").cast("long").alias("doc_id"), body.alias("body")]
    if keep_rows:
        fields.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    groups = max(8, -(-total // GROUP_BYTES))
    shards = max(8, -(-total // SHARD_BYTES))
    bits = max(4, int(total // 16 // 250_000).bit_length())
    spread = max(0, (shards - 1).bit_length() - bits)
    merge = max(MERGE_LEAST, shards)
    # dealt by id and text, so that rows without an id, or with one id, spread
    base = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(groups)).cast("int").alias("g"), *fields)
    listed = base.groupBy("g").applyInArrow(_list_fingerprints(bits), "bucket int, g int, f binary")
    shared = listed.groupBy("bucket").applyInArrow(_shared_fingerprints, "g int, f binary, level binary")
    heads = base.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_head_segments(bits, spread), _HEADS_SQL)
    resolved = heads.groupBy("bucket").applyInArrow(_resolve(spread), _ROUTE_SQL)
    told = resolved.where("kind <> 'claim'").select("kind", "e", "d", F.col("to").alias("g"))
    sent = base.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_ship_segments(bits + spread), "shard int, salted boolean, g binary, e binary, d binary, id binary, size binary, body binary")
    none = F.lit(None).cast("binary")
    claims = resolved.where("kind = 'claim'").select(F.col("to").alias("shard"), F.lit(False).alias("salted"), "g", "e", "d", F.col("m").alias("id"), none.alias("size"), none.alias("body"))
    dealt = sent.unionByName(claims).groupBy("shard")
    columns = ("kind", "e", "d", "m", F.col("to").alias("g"))
    merged = dealt.applyInArrow(_classes(merge, True), _ROUTE_SQL).groupBy("kind", "to").applyInArrow(_merge, _ROUTE_SQL)
    news = dealt.applyInArrow(_classes(merge, False), _ROUTE_SQL).select(*columns).unionByName(merged.select(*columns))
    names = ("doc_id", "row") if keep_rows else ("doc_id",)
    field = lambda name, kind: T.StructField(name, kind)
    schema = [field("doc_id", T.LongType())] + ([field("row", base.schema["row"].dataType)] if keep_rows else [])
    schema += [field(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [field("kept_sha256", T.StringType())]
    schema += [field("kept", T.BinaryType()), field("emptied", T.BooleanType())] if keep_rows else []
    return base.groupBy("g").cogroup(news.groupBy("g")).applyInArrow(_cut(names), T.StructType(schema))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut from text; a character that is cut in two goes whole.  Documents of which
    nothing but blanks is left go, unless they were blank before; null texts stay null.  A column n_chars, if there
    is one, follows the text."""
    out = remove_repeats(docs, keep_rows=True).where("not emptied")
    text = F.col("kept").cast("string")
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[(fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
