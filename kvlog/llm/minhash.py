"""Near-duplicate documents by bottom-k sketches.

1. One hash function turns a document's 5-word shingles into a set of 64-bit values.  Equal sets collapse to their
   smallest doc_id first, so a group of copies of any size costs one row from there on.
2. The K smallest values of a set are its sketch.  The LISTED smallest go into inverted lists.
3. Lists generate pairs.  A list of up to LIST_PAIRS sets gives all its pairs.  A longer one never does: its sets
   are compared with one pivot, then told apart by their differences to it (``_long_lists``, ``_by_differences``).
4. The union sketch of a pair estimates its similarity and drops pairs far below the threshold; the rest is
   confirmed on the full sets, recomputed from the text of the documents concerned only.
5. Components of the confirmed links give the result.

Losses: a pair of similarity 0.75 shares none of the LISTED values with probability 0.25 ** LISTED (5e-20), and has
an estimate under ESTIMATE_LEAST with probability below 1e-8; losses of long lists (below 1e-8 each) are stated
at ``_long_lists``.  Links are confirmed on full sets, or follow from the exact size of a difference of full sets.

Defined results: null, empty or blank text has an empty set, no links, and is its own component; fewer than five
words make one shingle; rows that repeat a doc_id give one row each with the same component; an empty table gives
an empty table; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import frugal
from .graph import components
from .scratch import materialize

K = 64
LISTED = 32
#: Lists of more sets never give all their pairs.
LIST_PAIRS = 12
LONG_LEAST = 9
LIST_ALL = 0.65
PIVOT_LISTS = 16
#: One task judges a list of at most so many sets, with so many differences; longer ones are split.
LIST_MEMBERS = 4096
LIST_ELEMENTS = 4_000_000
LEVELS = 6
BLOCK = 1024
ESTIMATE_LEAST = 0.42
_WORDS_KEPT = 100_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, words: dict[bytes, int], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles.  bytes.lower() and bytes.split() touch ASCII only, which is
    the contract's A-Z and its six blanks."""
    if not text:
        return np.empty(0, np.uint64)
    split = text.lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = max(1, len(h) - size + 1)
    acc = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        acc = _mix(acc + h[k : k + n] + np.uint64(k + 1))
    return np.unique(acc)


def _binary(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


_FLIP = np.uint64(1 << 63)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    """Sorted unsigned values as array<long>, in the same order."""
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array((flat ^ _FLIP).view(np.int64)))


@frugal
def _sketches(batches):
    words = _WordHashes()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, digests, sketches = [], [], []
        for text in _binary(batch.column("text")):
            s = shingle_set(text, words)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(s[:K].copy())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)], names=["doc_id", "n", "digest", "sketch"])


@frugal
def _full_sets(batches):
    words = _WordHashes()
    for batch in batches:
        if batch.num_rows:
            sets = [shingle_set(t, words) for t in _binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(sets)], names=["id", "s"])


def _ints(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _estimates(batches):
    """Of the K smallest values of the union, the share that both sketches hold."""
    for batch in batches:
        (x, xo), (y, yo) = _ints(batch.column("x")), _ints(batch.column("y"))
        got = []
        for i in range(batch.num_rows):
            p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
            both = np.sort(np.concatenate((p, q)))
            twin = both[1:] == both[:-1]
            first = np.append(True, ~twin)
            among = np.cumsum(first) <= K
            got.append(float((twin & among[1:]).sum() / max(1, min(K, first.sum()))))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], names=["a", "b", "est"])


def _jaccards(batches):
    for batch in batches:
        (x, xo), (y, yo) = _ints(batch.column("x")), _ints(batch.column("y"))
        inter, union = [], []
        for i in range(batch.num_rows):
            p, q = x[xo[i] : xo[i + 1]], y[yo[i] : yo[i + 1]]
            both = np.sort(np.concatenate((p, q)))
            c = int((both[1:] == both[:-1]).sum())
            inter.append(c)
            union.append(len(p) + len(q) - c)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "inter", "uni"])


def _with(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with the arrays of both; plain equi-joins, so a popular pivot can be split."""
    v = values.select(F.col("id"), F.col(column))
    out = pairs.join(v.withColumnsRenamed({"id": "a", column: "x"}), "a")
    return out.join(v.withColumnsRenamed({"id": "b", column: "y"}), "b").select("a", "b", "x", "y")


class _Verifier:
    """Judges pairs by sketches (id, sketch), then by full sets: ``stored`` ones (id, s), else those of the texts."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, stored: DataFrame | None = None):
        self.docs, self.sketches, self.stored = docs, sketches, stored

    def estimate(self, pairs: DataFrame) -> DataFrame:
        return _with(pairs, self.sketches, "sketch").mapInArrow(_estimates, "a long, b long, est double")

    def sets(self, ids: DataFrame) -> DataFrame:
        """Full sets (id, s) of the documents in ``ids`` (id), from their texts."""
        texts = self.docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
        return texts.mapInArrow(_full_sets, "id long, s array<long>")

    def jaccard(self, pairs: DataFrame) -> DataFrame:
        """Exact (a, b, inter, uni) of pairs; texts are read for their documents only."""
        sets = self.stored
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        return _with(pairs, sets, "s").mapInArrow(_jaccards, "a long, b long, inter long, uni long")


def _short_pairs(lists: DataFrame) -> DataFrame:
    """All pairs of lists, each of at most LIST_PAIRS sets; the size filter 3/4 <= |A|/|B| <= 4/3 is exact.  If sets
    have a component c, pairs inside one component are left out."""
    apart = "c" in lists.columns
    packed = lists.groupBy("v").agg(F.collect_list(F.struct("id", "n", *["c"] * apart)).alias("m")).where("size(m) > 1")
    one = packed.select("m", F.explode("m").alias("p"))
    other = lambda q: q["c"] != F.col("p.c") if apart else F.lit(True)
    later = F.filter("m", lambda q: (q["id"] > F.col("p.id")) & other(q) & (4 * q["n"] >= 3 * F.col("p.n")) & (4 * F.col("p.n") >= 3 * q["n"]))
    return one.select(F.col("p.id").alias("a"), F.explode(later).alias("q")).select("a", F.col("q.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialize(docs.mapInArrow(_sketches, "doc_id long, n long, digest binary, sketch array<long>"), "sketch")
    owner = rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    n = rows.count()
    owner = materialize(owner, "owner", n)
    same = (rows["digest"] == owner["digest"]) & (rows["doc_id"] == owner["id"])
    reps = rows.join(owner, same).select("id", "n", "sketch")
    reps = materialize(reps, "reps", 4 * n)  # rows of K values: fewer a file
    check = _Verifier(docs, reps)
    entries = reps.select("id", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("v"))
    df = materialize(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "df", LISTED * n // 2)
    links = _confirm(check, _short_pairs(entries.join(df.where(F.col("df") <= LIST_PAIRS), "v")))
    links = materialize(links, "links")
    links = _long_lists(check, entries.join(df.where(F.col("df") > LIST_PAIRS), "v"), links)
    comp = components(links)
    label = owner.join(comp, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    # rows without a set stay out of the join, whose null keys would all meet in one task
    out = rows.where("n > 0").join(label, "digest", "left").unionByName(rows.where("n = 0").withColumn("component", F.lit(None).cast("long")))
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _confirm(check: _Verifier, pairs: DataFrame) -> DataFrame:
    likely = check.estimate(pairs).where(F.col("est") >= ESTIMATE_LEAST).select("a", "b")
    if check.stored is None:  # else the pairs are read once
        likely = materialize(likely, "likely")
    return check.jaccard(likely).where("100 * inter >= 75 * uni").select("a", "b").distinct()


def _long_lists(check: _Verifier, long: DataFrame, links: DataFrame) -> DataFrame:
    """Links that only long lists can show, added to ``links``.

    A pair that shares a value of a short list is known already.  A pair that shares long-list values only, and no
    fewer than its similarity implies, consists of two sets with many such values (LONG_LEAST of LISTED; loss below
    1e-8).  Only these sets go on, with all their shingles:

    - a shingle is hot if more than LIST_PAIRS of them hold it.  If one set of a pair is hot by no more than LIST_ALL,
      then without hot shingles the pair still has similarity 0.28, so lists of the K smallest of the other shingles
      show it (loss 0.72 ** 64).  Sets above that share list all their other shingles, so any that are shared show
      the pair.  These lists are short by definition;
    - what is left are pairs that share hot shingles only, so three quarters of each set are hot, and the bound
      ``size_fits`` holds.  They are near copies of few originals.  Each list of hot values (the PIVOT_LISTS smallest
      of a set; a single pair is missed with probability 0.25 ** PIVOT_LISTS) compares its sets with one pivot, the
      set that consists of hot shingles most.  Lists whose sets then are one component are done; the others go to
      ``_by_differences``.
    """
    many = long.groupBy("id").agg(F.count("*").alias("hot"), F.first("n").alias("n"))
    many = many.where((F.col("hot") >= LONG_LEAST) | ((F.col("n") <= LISTED) & (4 * F.col("hot") >= 3 * F.col("n"))))
    many = materialize(many.select("id"), "many", check.sketches.count())
    if many.isEmpty():
        return links
    sets = materialize(check.sets(many).withColumn("n", F.size("s").cast("long")), "sets")
    # all pairs from here on are among these sets, whose first K values are their sketches
    check = _Verifier(check.docs, sets.select("id", F.slice("s", 1, K).alias("sketch")), sets.select("id", "s"))
    shingle = sets.select("id", F.explode("s").alias("v"))
    hot = materialize(shingle.groupBy("v").agg(F.count("*").alias("df")).where(F.col("df") > LIST_PAIRS).select("v"), "hot")
    mine = shingle.join(hot, "v").groupBy("id").agg(F.sort_array(F.collect_list("v")).alias("h"))
    split = sets.join(mine, "id", "left").withColumn("h", F.coalesce("h", F.array().cast("array<long>")))
    rare, h = F.array_except("s", "h"), F.size("h").cast("long")
    split = split.select("id", "n", F.when(h > LIST_ALL * F.col("n"), rare).otherwise(F.slice(rare, 1, K)).alias("rare"), F.slice("h", 1, PIVOT_LISTS).alias("top"), h.alias("h"), (4 * h >= 3 * F.col("n")).alias("dominated"))
    split = materialize(split, "split")
    found = _confirm(check, _short_pairs(split.select("id", "n", F.explode("rare").alias("v"))))
    links = materialize(links.unionByName(found).distinct(), "links")
    lists = materialize(split.where("dominated").select("id", "n", "h", F.explode("top").alias("v")), "long")
    if lists.isEmpty():
        return links
    # pairs that share a rare shingle are known; others share hot ones at most, which bounds their similarity
    size_fits = 4 * F.least("h", "ph") >= 3 * (F.greatest("h", "ph") + (F.col("n") - F.col("h")) + (F.col("pn") - F.col("ph")))
    typical = F.struct((-F.col("h") / F.col("n")).alias("o"), F.xxhash64("id").alias("x"), "id", "n", "h")
    pivot = lists.groupBy("v").agg(F.min(typical).alias("p")).select("v", F.col("p.id").alias("p"), F.col("p.n").alias("pn"), F.col("p.h").alias("ph"))
    # lists with the same pivot become one
    members = materialize(lists.join(pivot, "v").select("p", "id", "n", "pn", "h", "ph").distinct(), "members", lists.count())
    pairs = members.where((F.col("id") != F.col("p")) & size_fits)
    pairs = pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
    links = materialize(links.unionByName(_confirm(check, pairs)).distinct(), "links")
    members = _unsettled(members.select(F.col("p").cast("string").alias("list"), "p", "id", "n"), links)
    if members.isEmpty():
        return links
    s = sets.select("id", "s")
    both = members.join(s, "id").join(s.withColumnsRenamed({"id": "p", "s": "ps"}), "p")
    return _by_differences(check, both.select("list", "id", "c", "n", _differ("s", "ps").alias("d")), links)


def _differ(x: str, y: str) -> Column:
    """The symmetric difference of two sets."""
    return F.concat(F.array_except(x, y), F.array_except(y, x))


def _unsettled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (list, id, ...) of the lists that hold more than one component, with the component c."""
    members = members.drop("c").join(components(links), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    members = materialize(members, "members")
    open_lists = members.groupBy("list").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("list")
    return materialize(members.join(open_lists, "list", "left_semi"), "open")


def _by_differences(check: _Verifier, members: DataFrame, links: DataFrame) -> DataFrame:
    """The links between components inside each list, added to ``links``; exact.

    ``members`` (list, id, c, n, d): the n-element sets of a list by their differences d to one reference set.  A and
    B are linked if 7 |A delta B| <= |A| + |B|, and A delta B = d(A) delta d(B), so differences, which are short, are
    all that is needed.  A list of at most LIST_MEMBERS sets goes to one task, which counts common elements and puts
    out links that join its components (``_judged``).  A longer one is split (``_split``) and its parts are treated in
    the same way.  Lists that are still too long after LEVELS splits are judged block against block.
    """
    for level in range(LEVELS + 1):
        per = members.groupBy("list").agg(F.count("*").alias("m"), F.sum(F.size("d")).alias("w"))
        per = materialize(per.select("list", ((F.col("m") > LIST_MEMBERS) | (F.col("w") > LIST_ELEMENTS)).alias("long"), "m"), "per")
        tagged = members.join(per, "list")
        short = tagged.where("not long").select("list", "id", "c", "n", "d")
        if level == LEVELS:
            short = short.unionByName(_blocks(tagged.where("long"), LIST_MEMBERS // 2))
        links = materialize(links.unionByName(short.groupBy("list").applyInArrow(_judged, "a long, b long")).distinct(), "links")
        big = tagged.where("long").drop("long")
        if level == LEVELS or per.where("long").isEmpty():
            return links
        links, few, members = _split(materialize(big, "big"), links)
        links = materialize(links.unionByName(_confirm(check, few)).distinct(), "links")
        members = _unsettled(members, links)
        if members.isEmpty():
            return links
    return links


def _split(big: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists of m sets each to lists by a rare difference: links found on the way, added to ``links``; pairs (a, b) of
    new lists of at most LIST_PAIRS sets; members (list, id, c, n, d) of the others.

    The reference of a list becomes the set of elements that most of its sets hold, so that no difference is held by
    more than half of them.  Let x(A) = 7 |d(A)| - |A|; A and B are linked if they share (x(A) + x(B)) / 14
    differences.  Let B* have the smallest x.  Sets with x(A) + x(B*) <= 0 are linked with B*.  Any other A shares at
    least t = (x(A) + x(B*)) / 14 > 0 differences with whatever it is linked with, and of two sets in different
    components one is such an A.  So they meet in the list of a difference among the |d| - t + 1 rarest of each (the
    prefix filter).  Lists of equal members count once.
    """
    part = big.select("list", "m", F.explode("d").alias("e")).groupBy("list", "e").agg(F.count("*").alias("k"), F.first("m").alias("m"))
    most = part.where("2 * k > m").groupBy("list").agg(F.collect_list("e").alias("r"))
    big = big.join(most, "list", "left").withColumn("d", F.when(F.col("r").isNull(), F.col("d")).otherwise(_differ("d", "r")))
    big = materialize(big.select("list", "id", "n", "d", (7 * F.size("d") - F.col("n")).alias("x")), "big")
    best = big.groupBy("list").agg(F.min(F.struct("x", F.xxhash64("id").alias("o"), "id")).alias("best")).select("list", F.col("best.id").alias("p"), F.col("best.x").alias("px"))
    big = big.join(best, "list")
    near = big.where((F.col("id") != F.col("p")) & (F.col("x") + F.col("px") <= 0))
    links = materialize(links.unionByName(near.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))).distinct(), "links")
    big = _unsettled(big, links)
    size = F.size("d").cast("long")
    shared = F.greatest(F.lit(1), F.ceil((F.col("x") + F.col("px")) / 14))
    e = big.select("list", "id", "c", (size - shared + 1).alias("prefix"), size.alias("size"), F.explode("d").alias("e"))
    often = e.groupBy("list", "e").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1")
    of = Window.partitionBy("list", "id")
    # elements that no other set has come first and find nothing
    e = e.join(often, ["list", "e"]).withColumn("alone", F.col("size") - F.count("*").over(of)).withColumn("r", F.row_number().over(of.orderBy("k", "e")))
    e = materialize(e.where("r + alone <= prefix and lo < hi").select("list", "e", "id", "c"), "prefix")
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in range(2)]
    lists = e.groupBy("list", "e").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), *hashes)
    lists = lists.where("lo < hi").groupBy("list", "m", "x0", "x1").agg(F.min("e").alias("e")).select("list", "e", "m")
    rows = e.join(lists, ["list", "e"]).join(big.select("list", "id", "n", "d"), ["list", "id"])
    rows = materialize(rows.select(F.concat_ws(":", "list", "e").alias("list"), "m", "id", "c", "n", "d"), "lists")
    few = rows.where(F.col("m") <= LIST_PAIRS).select("id", "n", "c", F.col("list").alias("v"))
    return links, _short_pairs(few), rows.where(F.col("m") > LIST_PAIRS).drop("m")


def _blocks(big: DataFrame, size: int) -> DataFrame:
    """Each list as lists of two blocks of about ``size`` sets, so that every pair meets."""
    count = F.ceil(F.col("m") / size).cast("int")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), count).cast("int")
    out = big.withColumn("k", count).withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return out.select(F.concat_ws("+", "list", F.least("i", "j"), F.greatest("i", "j")).alias("list"), "id", "c", "n", "d")


def _judged(table: pa.Table) -> pa.Table:
    """Links (a, b) that join the components of one list: a forest, so never more than its sets.  Common elements
    are counted for sets outside the largest component only, in blocks of rows and columns."""
    ids, c, n = (table.column(x).to_numpy() for x in ("id", "c", "n"))
    flat, ends = _ints(table.column("d"))
    flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
    size = np.diff(ends).astype(np.int64)
    _, c = np.unique(c, return_inverse=True)
    out = np.flatnonzero(c != np.bincount(c).argmax())
    a, b = [], []
    value, col, often = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), size)
    place = np.cumsum(often > 1) - 1
    keep = np.flatnonzero(often[col] > 1)
    row, col = row[keep], place[col[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    last = int(col[-1]) + 1 if len(col) else 0
    cuts = np.searchsorted(col, np.arange(0, last + BLOCK, BLOCK))
    above = np.arange(c.max(initial=0) + 1)

    def top(k: int) -> int:
        while above[k] != k:
            above[k] = k = above[above[k]]
        return k

    for s in range(0, len(out), BLOCK):
        own = out[s : s + BLOCK]
        common = np.zeros((len(own), len(ids)), np.float32)
        for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
            x = np.zeros((len(ids), BLOCK), np.float32)
            x[row[p:q], col[p:q] - k * BLOCK] = 1
            common += x[own] @ x.T
        apart = size[own][:, None] + size[None, :] - 2 * common.astype(np.int64)
        linked = (7 * apart <= n[own][:, None] + n[None, :]) & (c[own][:, None] != c[None, :])
        for i in np.flatnonzero(linked.any(axis=1)):
            _, first = np.unique(c[linked[i]], return_index=True)
            for j in np.flatnonzero(linked[i])[first]:
                u, v = top(c[own[i]]), top(c[j])
                if u != v:
                    above[v] = u
                    a.append(min(ids[own[i]], ids[j]))
                    b.append(max(ids[own[i]], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
