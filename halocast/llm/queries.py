"""The queries of this package, over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocast.llm import bpe, jaccard, learning, lm, mixing, neardup, negatives, pii, quality, sitetree, substrings, topk, toxicity, trie
from halocast.sources.tables import read_table


def _graded(scores: DataFrame, least: float) -> DataFrame:
    return scores.select(F.col("id").alias("doc_id"), (learning.fold("id") % 3 == 1).alias("held_out"), "score",
                         (F.col("score") >= least).cast("int").alias("predicted"))


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    docs = read_table(spark, sf_dir, "documents")
    field = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return _graded(quality.score(docs, field), 0.5)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = bpe.encode(read_table(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode(tokens, path, pattern, with_text=False).withColumnRenamed("id", "doc_id")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    members, _ = jaccard.jaccard_join(read_table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                          F.col("component").alias("component_id"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base score and its log10 probability under the model."""
    return lm.score(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its number of partners and its component; the smallest id of a component is kept."""
    found = neardup.near_duplicates(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages that occur elsewhere too, and those to remove."""
    spans = substrings.repeated_spans(read_table(spark, sf_dir, "documents"))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, s: n + s["last"] - s["first"])
    return spans.select(F.col("id").alias("doc_id"), F.size("repeated").alias("n_repeated"), chars("repeated").alias("repeated_chars"),
                        F.size("removed").alias("n_removed"), chars("removed").alias("removed_chars"), "repeated", "removed")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector."""
    rows = read_table(spark, sf_dir, "embeddings")
    return topk.exact_topk(rows, F.pmod(F.col("vec_id"), F.lit(50)) == 0, k=5)


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, count_col="n_entities")


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, counted over the copies it holds, and where the first of them stands."""
    docs = read_table(spark, sf_dir, "documents")
    return mixing.taken(docs, mixing.plan(docs)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken",
        F.round("first_position", 9).alias("first_position"))


def op10_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score."""
    docs = read_table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _graded(toxicity.score(docs, machine), 0.7)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector and each of its positives."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


def op12_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = sitetree.main_text(read_table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie over the rebuilt conversations."""
    nodes = trie.prefix_trie(trie.paths(read_table(spark, sf_dir, "conversations"), graft=(5, 9)))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_lm_scores": op4_lm_scores,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_toxicity_fm": op10_toxicity_fm,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_html_main_text": op12_html_main_text,
    "op13_conversation_trie": op13_conversation_trie,
}
