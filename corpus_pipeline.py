"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
and what is left is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it again.

Rows without doc_id pass the first three stages (they cannot be labelled or grouped) and have no place in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, packing, substring_dedup, toxicity
from tessera.llm.common import stored, table

TOKENIZER = "byte_bpe_50k.json"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled documents among docs and drops those that score 0.7 or more."""
    field = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, field, 0.7)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that five-word shingles with a similarity of 0.75 link."""
    return jaccard_join.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts all words that windows of 35 words which occur elsewhere cover; n_chars follows the text. (Levels of longer windows
    would only tell how long repeats are: what they cover, the first level covers.)"""
    cut = substring_dedup.dedup(docs, levels=False).select(docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in pieces, with their sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", toxicity_stage), ("ngram_jaccard_join", jaccard_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: SQL cannot express the classifier and the packing; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
