"""From documents to packed sequences: a quality classifier, exact and near deduplication, mixing to target weights, packing.

Each stage works on all that the one before kept; its result is written and read again as the next one's documents. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonegrain.llm import exact_dedup, jaccard_join, mixing, packing, quality
from zonegrain.llm.common import saved


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality ranking accepts.

    A null text is scored as the empty text; rows with equal texts, ties of the score included, stay or go together.
    Texts count whole. Repeated rows and rows without doc_id are documents of their own; a doc_id that isn't labelled is
    no obstacle. An empty table gives no row. Other columns stay as they are, whatever their names.
    """
    return quality.accepted(docs, quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id.

    Null counts as the empty text, and a null doc_id as smaller than any other. Of rows that repeat text and doc_id any
    one stays; a doc_id that comes again with another text keeps that text. An empty table gives no row. Other columns
    stay as they are.
    """
    return exact_dedup.survivors(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Texts without words (null too) have no near copies and all stay. Rows without doc_id go if their group has a row with
    one; else the one with the least hash of its text stays. Rows go by doc_id and text: another text under the same
    doc_id stays. Of rows that repeat both one stays. An empty table gives no row. Other columns stay as they are.
    """
    return jaccard_join.representatives(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the rates that bring the languages to their target shares of tokens; no rate is above 1.

    Each row has its own rate and is drawn by its doc_id (null is one value more) and text, so repeated rows stay or go
    together. A null or empty text has no tokens and the rate of the prior. An empty table gives no row. Other columns stay as they are.
    """
    labelled = mixing.by_language(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.chosen(docs, mixing.mix(docs, labelled, mixing.TARGETS, max_rate=1.0))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens.

    A null or empty text is its end token. Each row, repeated or without doc_id, is a document of its own. An empty table
    gives no piece. Other columns aren't read.
    """
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("exact dedup", distinct), ("n-gram Jaccard join", unlike), ("mixing sources to target weights", mixed), ("packing", packed)]

#: SQL can't express the classifiers, the rates or the tokenizer: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
