"""Mixing sources to target weights by Poisson replication, native expressions only.

``targets`` gives named sources their share of the output; every other source (a null source too) belongs to one
rest, which gets what is left and so keeps its inner proportions.  With N units in all and n units in a class of
weight w, the class's mean repetition rate is ``scale * w * N / n``.  A document's copy number inverts the Poisson
distribution at a uniform number taken from a hash of its id and the seed, so reruns and lost executors give the
same copies.  A rate above 64 is dealt over several such draws of equal mean, each with a hash of its own; the sum of
independent Poisson numbers is Poisson with the whole rate, so no target is cut.  Copies are then shuffled globally: a range exchange on a hash of (id, copy, seed), sorted inside.

Only one row per named source (and one for the rest) ever reaches the driver, whatever the number of documents.
The exchange key is a hash, so a source with a third of all rows spreads like any other.

Defined results: null text has zero units; rows with the same id and seed get the same number of copies; a class
without units gets no rows beyond zero; an empty table gives an empty table; very long texts are units like any
other; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Production targets of the synthetic corpus: the hot source falls to a tenth, two small ones are raised.
TARGETS = {"src0": 0.10, "src1": 0.08, "src2": 0.08}
#: Greatest mean of one draw.
MAX_RATE = 64.0


def poisson_steps(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... until the next term is below 1e-18."""
    steps, total, k = [], 0.0, 0
    while rate > 0 and (k <= rate or k < 8 or math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) > 1e-18):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        steps.append(total)
        k += 1
    return steps


def uniform(*parts: Column | str) -> Column:
    """52 bits of an MD5 of the parts as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, targets: dict[str, float], unit: str, scale: float, source: str = "source", text: str = "text") -> tuple[dict[str, float], float]:
    """Mean repetition rate of each named source, and of the rest."""
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("weights must not be negative nor exceed 1 in sum")
    units = F.coalesce(F.length(F.col(text)), F.lit(0)) if unit == "chars" else F.lit(1)
    kind = F.when(F.col(source).isin(list(targets)), F.col(source)) if targets else F.lit(None).cast("string")
    sums = {r[0]: r[1] or 0 for r in docs.groupBy(kind.alias("k")).agg(F.sum(units.cast("long"))).collect()}
    total = sum(sums.values())
    rate = lambda w, n: scale * w * total / n if n else 0.0
    return {k: rate(w, sums.get(k, 0)) for k, w in targets.items()}, rate(max(0.0, 1 - sum(targets.values())), sums.get(None, 0))


def copy_number(rate: float, key: str, seed: int) -> Column:
    """Poisson number of mean ``rate`` for a key: the sum of as few draws as hold MAX_RATE each at most."""
    if rate <= 0:
        return F.lit(0)
    draws = max(1, math.ceil(rate / MAX_RATE))
    steps = F.array(*[F.lit(x) for x in poisson_steps(rate / draws)])
    draw = lambda u: F.size(F.filter(steps, lambda t: t <= u))
    first = draw(uniform(key, F.lit(f"mix{seed}")))
    if draws == 1:
        return first
    more = F.sequence(F.lit(1), F.lit(draws - 1))
    return F.aggregate(more, first, lambda n, k: n + draw(uniform(key, F.concat(F.lit(f"mix{seed}."), k.cast("string")))))


def _copies(docs: DataFrame, targets: dict[str, float], seed: int, unit: str, scale: float, key: str, partitions: int | None) -> DataFrame:
    """Each row as the struct __row, so that no name can clash, with copy_no (from 1) and mix_key."""
    named, rest = rates(docs, targets, unit, scale)
    count = lambda rate: copy_number(rate, "__key", seed)
    copies = count(rest)
    if named:
        chosen = None
        for name, rate in sorted(named.items()):
            chosen = (F if chosen is None else chosen).when(F.col("__source") == name, count(rate))
        copies = chosen.otherwise(copies)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__key"), F.col("source").alias("__source"))
    out = out.withColumn("__n", copies).where("__n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    mix_key = F.md5(F.concat_ws(":", F.coalesce(F.col("__key").cast("string"), F.lit("null")), F.col("copy_no").cast("string"), F.lit(f"order{seed}")))
    out = out.select("__row", "copy_no", mix_key.alias("mix_key"))
    out = out.repartitionByRange(partitions, "mix_key") if partitions else out.repartitionByRange("mix_key")
    return out.sortWithinPartitions("mix_key")


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED, unit: str = "chars", scale: float = 1.0, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """All columns of ``docs`` plus copy_no (from 1) and mix_key, one row per copy, in global random order.  Columns
    of these two names in ``docs`` are replaced; ``mix_rows`` keeps them."""
    own = [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c not in ("copy_no", "mix_key")]
    return _copies(docs, targets, seed, unit, scale, key, partitions).select(*own, "copy_no", "mix_key")


def mix_rows(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: int = SEED, unit: str = "chars", scale: float = 1.0, key: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """The rows of ``mix`` with the columns of ``docs`` alone, whatever their names."""
    return _copies(docs, targets, seed, unit, scale, key, partitions).select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def oracle(targets: dict[str, float] = TARGETS, seed: int = SEED) -> str:
    values = ", ".join(f"('{k}', {w!r})" for k, w in sorted(targets.items()))
    return f"""
WITH t(src, w) AS (VALUES {values}),
d AS (SELECT *, row_number() OVER () AS rid, CASE WHEN source IN (SELECT src FROM t) THEN source END AS k FROM documents),
s AS (SELECT k, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS n FROM d GROUP BY k),
r0 AS (SELECT s.k, CASE WHEN s.n > 0 THEN coalesce(t.w, 1 - (SELECT sum(w) FROM t)) * (SELECT sum(n) FROM s) / s.n ELSE 0 END AS whole
  FROM s LEFT JOIN t ON t.src = s.k),
r AS (SELECT k, CAST(ceil(whole / {MAX_RATE}) AS BIGINT) AS draws, whole / ceil(whole / {MAX_RATE}) AS rate FROM r0 WHERE whole > 0),
p AS (SELECT k, sum(exp(i * ln(rate) - rate - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) AS cum
  FROM r, (SELECT unnest(range(0, 200)) AS i)),
v AS (SELECT d.*, unnest(range(0, r.draws)) AS draw FROM d JOIN r ON r.k IS NOT DISTINCT FROM d.k),
u AS (SELECT *, CAST(CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix{seed}' || CASE WHEN draw > 0 THEN '.' || draw ELSE '' END)[1:13] AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM v),
q AS (SELECT u.rid, (SELECT count(*) FROM p WHERE p.k IS NOT DISTINCT FROM u.k AND p.cum <= u.u) AS n FROM u),
c AS (SELECT d.doc_id, d.text, d.source, z.n FROM d JOIN (SELECT rid, CAST(sum(n) AS BIGINT) AS n FROM q GROUP BY rid) z USING (rid))
SELECT doc_id, source, text, CAST(copy_no AS INTEGER) AS copy_no, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || copy_no || ':order{seed}') AS mix_key
FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy_no FROM c)
"""
