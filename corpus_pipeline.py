"""A training corpus from raw documents: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
The caller stores a stage's result before it starts the next one, so a stage first frees the scratch tables of
those before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm import bpe, minhash, mixing, quality, scratch, suffix_dedup


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects.  A null or empty text has no words and goes; repeated rows and null ids
    are judged like any other row; long texts are read whole; extra columns stay."""
    return quality.keep_good(docs)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates; rows that repeat id and text count once.  Texts
    without words are linked with nothing and stay, one row for each id.  A document without an id goes if one with
    an id is its copy; else rows without an id stay, equal texts once."""
    scratch.release()
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__kept")), "left_semi")
    return rows.dropDuplicates(["__id", "__hash"]).select("__row.*")


def _repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document holds.  A document goes if nothing but blanks is
    left of it; null, empty and blank texts stay as they are; a null id counts as the largest; n_chars follows."""
    scratch.release()
    return suffix_dedup.without_repeats(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order.  A null source belongs to the
    rest; rows with one id get the same number of copies; texts without characters weigh nothing."""
    scratch.release()
    return mixing.mix_rows(docs)


def _tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids of every row, checked by decoding; null and empty texts have none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", _rules),
    ("near duplicates", _near),
    ("repeated passages", _repeats),
    ("source mixture", _mix),
    ("byte-level tokens", _tokens),
]

#: Components of links and byte-level removal have no SQL of bearable cost; a test compares run() with brute force
#: through all five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's folder goes as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = f"{scratch.shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{scratch.uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.delete(spark, before)
        before = path
    scratch.release()
    return docs
