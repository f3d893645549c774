"""Quality rules as a short-circuit cascade, native expressions only.

Each rule is a boolean expression that says *reject*.  ``plan_order`` measures, on a random sample, how often a
rule rejects and how long it takes, and orders rules by rejection per cost; ``cascade`` tests them in that order
inside one CASE, which stops at the first rule that rejects.  The order changes what is computed, never a verdict.

Defined results: null text counts as empty; an empty text has zero words and fails the base rule; ties, repeated
rows and extra columns pass through untouched; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Rows (on average) and files that the cost estimate looks at; only two figures a rule come out of it.
SAMPLE_ROWS, SAMPLE_FILES, SAMPLE_SEED = 1_000, 64, 20_260
_P = "__q_"


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the metric columns n_words, word_chars, n_symbols, n_dup_lines, n_lines,
    n_repeat_words and over ``__q_text`` and ``__q_words``; null counts as not rejecting."""

    name: str
    rejects: str


#: Production rules beyond the base rule.
RULES = (
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("stutter", f"4 * size(filter({_P}words, (x, i) -> x = get({_P}words, i - 1))) > n_words"),
    Rule("capitals", rf"2 * length(regexp_replace({_P}text, r'[^\p{{Lu}}]+', '')) > length(regexp_replace({_P}text, r'[^\p{{L}}]+', ''))"),
)
BASE_FAILS = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the metric columns.  All work stays inside a row: no shuffle, so a hot source cannot skew it.

    Repeated windows: 64-bit hashes of all 5-word windows, built by doubling (1, 2, 4, 5 words), tell in linear
    time whether a text has any repeat; only then they are sorted with their places and neighbours compared.
    Everything but the split into words sits in one projection, because each projection copies the row.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = df.withColumn(f"{_P}text", own).withColumn(f"{_P}words", F.array_remove(F.split(own, WORD_GAP), ""))
    t, w = F.col(f"{_P}text"), F.col(f"{_P}words")
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumns(
        {
            f"{_P}lines": _let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))),
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, "[^" + SYMBOLS + "]+", "")).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.size(w) > 5, _repeat_words(w)), F.lit(0)).cast("long"),
        }
    )
    n, d = F.col(f"{_P}lines.n"), F.col(f"{_P}lines.d")
    return df.withColumns({"n_lines": n.cast("long"), "n_dup_lines": (n - d).cast("long")})


def _let(value: Column, body) -> Column:
    """``body`` over ``value`` computed once, inside one expression and so one row copy."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in 5-word windows that occur twice; null if there is none."""
    both = lambda x, y: F.xxhash64(x, y)
    cut = lambda c, first, less: F.slice(c, F.lit(first + 1), F.greatest(F.size(words) - less, F.lit(0)))
    four = lambda h2: F.zip_with(cut(h2, 0, 4), cut(h2, 2, 4), both)
    five = lambda h: F.zip_with(_let(F.zip_with(cut(h, 0, 1), cut(h, 1, 1), both), four), cut(h, 4, 4), both)
    windows = _let(F.transform(words, lambda x: F.xxhash64(x)), five)

    def covered(p: Column) -> Column:
        runs = F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5))))
        return F.aggregate(runs, F.lit(0), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twin = lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return _let(windows, lambda h: F.when(F.size(h) > F.size(F.array_distinct(h)), _let(_let(placed(h), places), covered)))


def _sample(df: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` random rows.  Of a table of many files, SAMPLE_FILES chosen by a hash of their names are read, so
    the cost does not grow with the table; a row is drawn from them with equal chance, wherever it lies."""
    picked, files = df, df.inputFiles()
    if len(files) > SAMPLE_FILES:
        names = {f.rsplit("/", 1)[-1] for f in files}
        chosen = sorted(names, key=lambda n: hashlib.sha256(n.encode()).digest())[:SAMPLE_FILES]
        try:
            picked = df.where(F.col("_metadata.file_name").isin(chosen))
        except AnalysisException:  # not a plain scan: rows have no file
            picked = df
    found = picked.count()
    if not found and picked is not df:
        picked, found = df, df.count()
    return picked.sample(False, min(1.0, rows / max(1, found)), SAMPLE_SEED)


def plan_order(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second on a random sample, best first.

    The sample is stored with its metrics, so that a rule's time is its own: the better of two runs over the stored
    rows, less the better of two runs of a rule that does nothing."""
    if len(rules) < 2:
        return rules
    spark = df.sparkSession
    path = f"{scratch.shared_dir(spark)}/quality-sample-{uuid.uuid4().hex}"
    try:
        drawn = _sample(df.select(F.col(text).alias("text")), rows)
        with_metrics(drawn.repartition(1)).write.parquet(path)
        sample = spark.read.parquet(path)

        def measured(rejects: Column) -> tuple[float, float]:
            seconds = []
            for _ in range(2):
                began = time.perf_counter()
                share = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double"))).first()[0]
                seconds.append(time.perf_counter() - began)
            return min(seconds), share or 0.0

        idle = measured(F.length("text") < 0)[0]
        worth = {}
        for rule in rules:
            seconds, share = measured(F.expr(rule.rejects))
            worth[rule.name] = share / max(1e-4, seconds - idle)
    finally:
        scratch.delete(spark, path)
    return tuple(sorted(rules, key=lambda r: (-worth[r.name], r.name)))


def cascade(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", order: bool = True) -> DataFrame:
    """``df`` with the metrics, ``base_failed``, ``kept`` and ``rejected_by`` (null if kept)."""
    own = set(df.columns)
    rules = plan_order(df, rules, text) if order else rules
    out = with_metrics(df, text).withColumn("base_failed", F.expr(BASE_FAILS))
    first = F.when(F.col("base_failed"), F.lit("base"))
    first = reduce(lambda c, r: c.when(F.expr(r.rejects), F.lit(r.name)), rules, first)
    out = out.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())
    return out.drop(*[c for c in out.columns if c.startswith(_P) and c not in own])


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the metrics, base_failed and kept of every row of ``docs``; other columns are ignored."""
    out = cascade(docs.select("doc_id", F.col("text").alias("text")), rules)
    return out.select("doc_id", *METRICS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with the same columns; clashing names are safe."""
    packed = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    # a filter is not pushed below a projection with a running number, so metrics are computed once, not in the filter
    numbered = cascade(packed, rules).withColumn("__number", F.monotonically_increasing_id())
    return numbered.where("kept and __number >= 0").select("__row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (SELECT doc_id, rid, t, words, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM w),
g AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS s FROM (SELECT rid, words, unnest(range(1, n_words - 3)) AS i FROM m WHERE n_words > 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
runs AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS k FROM twice),
r AS (SELECT rid, sum(k) AS n FROM runs GROUP BY rid),
f AS (SELECT m.*, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN r USING (rid)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR 4 * len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) > n_words
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(t, '[^\p{L}]+', '', 'g'))) AS kept
FROM b
"""
