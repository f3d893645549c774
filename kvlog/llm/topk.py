"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components become integers floor(256 x).  A block of vectors is stored as posting segments: segment L holds, for
each dimension, the postings (vector, component) whose magnitude quantises to level L (2**(L-1) <= |x| < 2**L).
Queries meet segments from the highest impact down.  After a segment each vector's accumulated score is exact for
all postings seen so far, and every posting still to come is below 2**M, M the next level that occurs, so
sum_d |q_d| * (2**M - 1), over dimensions whose posting of that vector is unseen, bounds the rest.  Vectors whose
upper bound is below the k-th best lower bound are dropped for that query.  Processing stops only when that proof
leaves few possible members (or no segment is left); those are rescored exactly from the stored vectors.

Queries and vectors are dealt in blocks: each block of queries meets each block of vectors once, and only k rows per
query and block are merged.  The work is queries times vectors by the nature of an exact search.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; ties go to the
smaller vec_id; a query never finds its own row (vectors that repeat its id neither); vectors of another length than
the query never meet it; rows that repeat a query's id ask once, with the smallest vector, and each repeated row is a
candidate of its own; components and scores beyond 64 bits are held at the ends of that range; an empty table gives an empty table; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 512
TASK_QUERIES = 16
#: Stop once this many times k possible members are left to a query on average.
FEW = 8


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, dim and v (array<bigint>) of vectors that take part."""
    x = F.col(vec).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    ints = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    return vectors.where(x.isNotNull() & fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.size(x).alias("dim"), ints.alias("v"))


def _pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids = table.column("vec_id").to_numpy()
    flat = table.column("v").combine_chunks()
    flat = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False)
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "v": pa.array([flat.astype(np.int64).tobytes()], pa.binary())})


def _packed(vectors: DataFrame, size: int, count: int) -> DataFrame:
    """Rows of about ``size`` vectors of one dimension each, dealt by a hash of the id."""
    blocks = max(1, -(-count // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, v binary")


class Index:
    """Posting segments of one block, highest impact first."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], v[order]
        level = np.frexp(np.abs(self.v).astype(np.float64))[1]  # |x| in [2**(level-1), 2**level)
        self.segments = []
        for at in sorted(set(np.unique(level)) - {0}, reverse=True):
            self.segments.append((int(at), np.where(level == at, self.v, 0).astype(np.float64)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int):
        """Rows (query, id, score): the k best of the block for each query, ties to the smaller id."""
        n, dim = self.v.shape
        most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if most(self.v) * most(queries) * dim >= 1 << 52:
            return self._in_full(queries, own, k)
        q = queries.astype(np.float64)
        size = np.abs(q)
        allowed = self.ids[None, :] != own[:, None]
        score = np.zeros((len(q), n))
        unseen = np.ones(self.v.shape)
        possible = allowed.copy()
        for nth, (level, segment) in enumerate(self.segments):
            score += q @ segment.T
            if nth + 1 == len(self.segments):
                break
            unseen[segment != 0] = 0
            below = 2.0 ** self.segments[nth + 1][0] - 1
            rest = size @ (unseen.T * below)
            lower = np.where(allowed, score - rest, -np.inf)
            bar = np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)]
            possible = allowed & (score + rest >= bar[:, None])
            if possible.sum() <= FEW * k * len(q):
                break
        out = []
        for row in range(len(q)):
            p = np.flatnonzero(possible[row])
            exact = self.v[p] @ queries[row]
            best = np.lexsort((self.ids[p], -exact))[:k]
            out.append((np.full(len(best), row), self.ids[p][best], exact[best]))
        return [np.concatenate(x) for x in zip(*out)]


    def _in_full(self, queries: np.ndarray, own: np.ndarray, k: int):
        """Components too large for doubles: whole numbers of any size, scores held to 64 bits."""
        v, out = self.v.astype(object), []
        for row, q in enumerate(queries):
            p = np.flatnonzero(self.ids != own[row])
            exact = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in v[p] @ q.astype(object)] if len(p) else []
            best = sorted(range(len(p)), key=lambda j: (-exact[j], self.ids[p[j]]))[:k]
            out.append((np.full(len(best), row), self.ids[p][best], np.array([exact[j] for j in best], np.int64)))
        return [np.concatenate(x) for x in zip(*out)]


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], blocks: pa.Table, queries: pa.Table) -> pa.Table:
        found = [[], [], []]
        if blocks.num_rows and queries.num_rows:
            dim = key[0].as_py()
            shape = lambda raw: np.frombuffer(raw, np.int64).reshape(-1, dim)
            ids = np.frombuffer(b"".join(blocks.column("ids").to_pylist()), np.int64)
            index = Index(ids, np.frombuffer(b"".join(blocks.column("v").to_pylist()), np.int64).reshape(len(ids), dim))
            for raw_ids, raw in zip(queries.column("ids").to_pylist(), queries.column("v").to_pylist()):
                own, vectors = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw, np.int64).reshape(-1, dim)
                for s in range(0, len(own), QUERY_BLOCK):
                    row, hit, score = index.search(vectors[s : s + QUERY_BLOCK], own[s : s + QUERY_BLOCK], k)
                    for out, x in zip(found, (own[s : s + QUERY_BLOCK][row], hit, score)):
                        out.append(x)
        columns = [np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in found]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best vectors of each query (all, if fewer); ``queries`` are rows like
    those of ``vectors``, whose vec_id names the row that is left out."""
    v, q = usable(vectors, vec), usable(queries, vec)
    n = vectors.count()
    index = _packed(v, BLOCK, n)
    q = q.groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    asked = queries.count()
    packed = _packed(q, QUERY_BLOCK, asked)
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-asked // (QUERY_BLOCK * TASK_QUERIES)))
    # a task meets one block of vectors with TASK_QUERIES blocks of queries, however many there are
    each = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    sent = packed.select("dim", "ids", "v", (F.col("block") % parts).alias("part"), each(blocks, "block"))
    index = index.select("dim", "block", "ids", "v", each(parts, "part"))
    keys = ("dim", "block", "part")
    found = index.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT vec_id, arg_min(v, (len(v), v)) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
