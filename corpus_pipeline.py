"""The corpus pipeline: judge, de-duplicate, replace personal data, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocast.llm import bpe, jaccard, mixing, pii, quality
from halocast.llm.sizes import sendable
from halocast.session import stored
from halocast.sources.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality field rejects (score below 0.5).

    The field learns from the labelled training folds of the given documents.
    """
    field = quality.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return quality.score(docs, field, keep=docs.columns).where("__score >= 0.5").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, keep one row: that of the smallest id, null ids last.

    Rows are told apart by id and text, so rows that share an id stay or go each by its own text, and of rows that are
    equal in both one stays. Texts without words are copies of nothing; their rows all stay.
    """
    key = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("__key", key)
    members = jaccard.jaccard_join(keyed, id_col="__key")[0].where("n > 0")
    rows = keyed.groupBy("__key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    known = stored(members.distinct().join(rows, members["id"] == rows["__key"]).select("id", "component", "doc_id", "copies"), "known")
    first = known.groupBy("component").agg(F.min_by("id", F.struct(F.col("doc_id").isNull(), "doc_id", "id")).alias("first"))
    # what goes as a whole, and what is there several times
    gone = stored(known.join(first, "component").where("id <> first OR copies > 1").select(
        F.col("id").alias("__key"), (F.col("id") != F.col("first")).alias("__gone")), "extra")
    marked = keyed.join(sendable(gone), "__key", "left")
    once = marked.where("__gone IS NOT NULL AND NOT __gone").dropDuplicates(["__key"])
    return marked.where("__gone IS NULL").unionByName(once).select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; ``n_chars`` follows the new text."""
    return pii.replace(docs).withColumn(
        "n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: a row for each copy taken, sorted by training position."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document of the mix as token ids."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, path, pattern).select(F.col("id").alias("doc_id"), F.size("ids").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", replace_personal_data),
    ("mix", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores, keyed digests and BPE ids are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
