"""Language spans and document language.

Training counts hashed character trigrams (word edges marked) of a bounded, hash-chosen sample of labelled rows: at
most about TRAIN_ROWS a language.  A word's score for a language is the log-likelihood of its trigrams.  Script
ranges come first: a language is a candidate for a word only if training saw it in the word's script.  Viterbi then
labels the words of a document, where a change of language costs SWITCH.  Texts are handled as arrays of code
points, and all documents of a batch advance in step, so the cost is a few array operations a character.

Defined results: text that is null or has no letter is ``und`` with score 0 and no spans; a document gets the
language with most words, ties to the alphabetically first, and as score that language's share of the words; without
labelled rows all is ``und``; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import strings

TRAIN_ROWS = 1500
BUCKETS = 1 << 16
SWITCH = 6.0
#: Characters that are handled at once; a longer text is handled alone.
STEP_CHARS = 2_000_000

# First code point and script of Unicode ranges that hold letters.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x1380, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0xFF66, "Kana"),
    (0xFFA0, "Other"),
    (0x20000, "Han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = sorted({b for _, b in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(b) for _, b in SCRIPTS])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def words_of(texts: list[str | None]):
    """Of all texts together: trigram bucket by letter, first letter of each word, script of each word, words a text."""
    joined = "\0".join((t or "").lower() for t in texts)
    c = np.frombuffer(("\0" + joined + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[c]
    at = np.flatnonzero(is_letter)
    edge = np.where(is_letter, c, 1).astype(np.uint64)
    mix = (edge[at - 1] * np.uint64(0x9E3779B97F4A7C15) ^ edge[at] * np.uint64(0xC2B2AE3D27D4EB4F) ^ edge[at + 1] * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
    bucket = (mix >> np.uint64(48)).astype(np.int64)
    first = np.flatnonzero(~is_letter[at - 1])
    script = _SCRIPT_OF[np.searchsorted(_FIRST, c[at[first]], "right") - 1]
    breaks = np.flatnonzero(c == 0)[1:]  # a text that holds U+0000 itself is handled by the caller
    count = np.diff(np.append(0, np.searchsorted(at[first], breaks)))
    return bucket, first, script, count


def _clean(texts: list[str | None]) -> list[str | None]:
    return [t.replace("\0", " ") if t and "\0" in t else t for t in texts]


@dataclass
class Model:
    langs: list[str]
    logs: np.ndarray  # language by bucket
    masks: np.ndarray  # script by language

    def scores(self, bucket: np.ndarray, first: np.ndarray, script: np.ndarray) -> np.ndarray:
        out = np.empty((len(first), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.logs[k][bucket], first) if len(first) else 0
        out = np.maximum(out - out.max(1, keepdims=True, initial=-np.inf), -30.0) if len(first) else out
        return np.where(self.masks[script], out, -60.0)


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = _clean(strings(batch.column("text")))
        for lang in sorted(set(langs)):
            for t in (t for t, own in zip(texts, langs) if own == lang):
                bucket, first, script, _ = words_of([t])
                row = sums.setdefault(lang, np.zeros(BUCKETS + len(_NAMES), np.int64))
                row[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                row[BUCKETS:] += np.bincount(script, minlength=len(_NAMES))
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from (text, lang) rows, of which about ``rows`` a language are taken, by a hash of the text (and of
    doc_id, if there is one, so that a text of many copies is thinned like others).  One row of fixed size a language
    reaches the driver."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang in sizes:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / sizes[lang]))).otherwise(share)
    picked = labelled.where(F.pmod(F.xxhash64(*(["doc_id"] if "doc_id" in labelled.columns else []), "text"), F.lit(1_000_000)) < share * 1_000_000)
    counted = picked.select("text", "lang").mapInArrow(_count, "lang string, counts binary").groupBy("lang").applyInArrow(_sum, "lang string, counts binary")
    got = {r[0]: np.frombuffer(r[1], np.int64) for r in counted.collect()} if sizes else {}
    langs = sorted(got)
    m = np.array([got[x][:BUCKETS] for x in langs], np.float64).reshape(len(langs), BUCKETS)
    s = np.array([got[x][BUCKETS:] for x in langs], np.float64).reshape(len(langs), len(_NAMES))
    masks = (s >= np.maximum(1, 0.002 * s.sum(1, keepdims=True))).T if langs else np.zeros((len(_NAMES), 0), bool)
    masks[~masks.any(1)] = True  # a script that no language has narrows nothing
    return Model(langs, np.log((m + 0.5) / (m.sum(1, keepdims=True) + 0.5 * BUCKETS)), masks)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Labels of all words; documents lie end to end in ``scores`` (word by language)."""
    ends = np.cumsum(lengths)
    order = np.argsort(-lengths, kind="stable")
    start = (ends - lengths)[order]
    left = lengths[order]
    n, k = scores.shape
    back = np.zeros((n, k), np.int8 if k < 128 else np.int16)
    label = np.zeros(n, back.dtype)
    longest = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(longest), "left")  # documents longer than t
    v = np.zeros((len(left), k))
    own = np.arange(k)
    for t in range(longest):
        a = active[t]
        at = start[:a] + t
        if t == 0:
            v[:a] = scores[at]
            continue
        p = v[:a]
        top = p.argmax(1)
        jump = p[np.arange(a), top] - switch
        stay = p >= jump[:, None]
        back[at] = np.where(stay, own, top[:, None])
        v[:a] = np.where(stay, p, jump[:, None]) + scores[at]
    state = v.argmax(1) if len(left) else np.empty(0, np.int64)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = start[:a] + t
        label[at] = state[:a]
        state[:a] = back[at, state[:a]]
    return label


def _predict(model: Model, spans: bool):
    k = len(model.langs)

    def run(batches):
        for batch in batches:
            texts = _clean(strings(batch.column("text")))
            pred, score, all_spans, s = [], [], [], 0
            while s < len(texts):
                e, size = s, 0
                while e < len(texts) and (e == s or size + len(texts[e] or "") <= STEP_CHARS):
                    size += len(texts[e] or "")
                    e += 1
                bucket, first, script, lengths = words_of(texts[s:e])
                if not k:
                    lengths, first = lengths * 0, first[:0]
                labels = viterbi(model.scores(bucket, first, script), lengths) if k else np.zeros(0, np.int64)
                votes = np.bincount(np.repeat(np.arange(e - s), lengths) * max(1, k) + labels, minlength=(e - s) * max(1, k)).reshape(e - s, -1)
                best = votes.argmax(1)
                for i in range(e - s):
                    pred.append(model.langs[best[i]] if lengths[i] else "und")
                    score.append(float(votes[i, best[i]] / lengths[i]) if lengths[i] else 0.0)
                if spans:
                    at = np.cumsum(lengths) - lengths
                    for i in range(e - s):
                        own = labels[at[i] : at[i] + lengths[i]]
                        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else []
                        all_spans.append([{"first_word": int(c), "words": int(n), "lang": model.langs[own[c]]} for c, n in zip(cut, np.diff(np.append(cut, len(own))))])
                s = e
            columns = [batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(all_spans, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    return run


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans: runs of words of one language).  Only text decides."""
    schema = "doc_id long, lang_pred string, score double" + (", spans array<struct<first_word:bigint,words:bigint,lang:string>>" if spans else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_predict(model, spans), schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    model = train(docs.where(~held_out()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
