"""A corpus pipeline of the operators in semlake.llm; each stage reads what its predecessor wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm import bpe, jaccard, lines, mixing, toxicity
from semlake.llm.common import table, written

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go; it learns from labelled documents of docs that are not held out.

    A null or empty text has the model's intercept as its score. Repeated rows and equal ids are judged row by row,
    texts whole; without labels of both kinds no document has a score of 0.5 unless most labels are toxic; an empty
    table stays empty; all columns, extra ones too, pass through.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxic_score(model, F.col("text")) < 0.5)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go from every document but the first; n_chars follows the text.

    A document that loses all its words in this way (a copy of earlier ones) goes, as nothing of it is left. Null and
    empty texts, and texts without a word, stay as they are. Repeated rows (one id, one text) count as one document and
    lose the same lines; equal ids with other texts are documents of their own; a null id comes first; an empty table
    stays empty; extra columns pass through.
    """
    found = lines.drop_template_lines(docs)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    columns = {c: F.col(c) for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")
    return found.where(left).select(*columns.values())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, and of rows with this id the one whose text has the least hash.

    Null and empty texts link with nothing, so their documents stay, but rows that repeat an id are one document. Rows
    without an id are never grouped: all stay. Texts are compared whole; an empty table stays empty; extra columns pass
    through.
    """
    kept = jaccard.near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    d = docs.select(F.col("doc_id").cast("long").alias("kept_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), row)
    one = d.where("kept_id is not null").groupBy("kept_id").agg(F.min_by("row", "h").alias("row"))  # before the join: combined where the rows are
    one = one.join(kept.hint("shuffle_merge"), "kept_id", "left_semi")
    return one.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)]).union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: by slot, then by place in the source, file by file (part files in the order of their names).

    No document goes. A null source is the source '', a null text has no length, null ids come first in their source,
    repeated rows follow one another, an empty table stays empty, extra columns pass through (columns named as the
    operator's own are replaced in its work and not returned).
    """
    clash = [c for c in docs.columns if c.lower() in mixing.ADDED]
    return mixing.mix_sources(docs).orderBy("mix_slot", "mix_start", "doc_id").select(*[c for c in docs.columns if c not in clash])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the ids of every remaining document, in digest, and of their decoding.

    A null text is an empty text; texts are encoded whole, row by row; an empty table gives an empty result; extra
    columns are not read.
    """
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("mixing", mix), ("bpe", encode)]
#: Models and merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(spark, docs, name)
    return docs
