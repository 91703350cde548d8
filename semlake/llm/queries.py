"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctw, exact, jaccard, lines, merkle, mixing, phrases, quality, secrets, token_files, toxicity, vectors
from .common import id_mod, shared_path, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.digest(spark, path)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_mod("doc_id", 5) == 0).alias("held_out"), toxicity.toxic_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_template_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), *mixing.ADDED)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_rows(table(spark, sf_dir, "documents"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_files": op1_token_files, "op2_quality": op2_quality, "op3_toxicity": op3_toxicity, "op4_lm": op4_lm, "op5_lines": op5_lines, "op5_templates": op5_lines,  # its older name
    "op6_secrets": op6_secrets, "op7_jaccard": op7_jaccard, "op8_mixing": op8_mixing, "op9_bpe": op9_bpe, "op10_vectors": op10_vectors, "op11_phrases": op11_phrases, "op12_merkle": op12_merkle, "op13_exact": op13_exact}
ORACLES: dict[str, str] = {"op5_lines": lines.ORACLE, "op5_templates": lines.ORACLE, "op7_jaccard": jaccard.ORACLE, "op8_mixing": mixing.ORACLE, "op11_phrases": phrases.ORACLE, "op12_merkle": merkle.ORACLE, "op13_exact": exact.ORACLE}
