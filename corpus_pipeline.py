"""A training corpus from raw documents: five operators, one after another.

Each stage takes (spark, docs, sf_dir) and gives what the next one reads; the first four keep the
columns of documents.  Between stages the rows are written as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkweave.llm.decontaminate import without_leaks
from inkweave.llm.mixing import mix_sources, take_mix
from inkweave.llm.ngram_join import ngram_jaccard_classes, one_of_each_class
from inkweave.llm.toxicity import fit_toxicity, without_toxic
from inkweave.llm.training_order import write_training_order
from inkweave.scale import cut_lineage

NGRAM, NUM, DEN = 5, 80, 100


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose worst window scores below 0.5; the model learns from the labels table."""
    return without_toxic(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a Jaccard similarity of word 5-grams of 0.8 or more."""
    return one_of_each_class(docs, ngram_jaccard_classes(docs, n=NGRAM, num=NUM, den=DEN))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_mix(docs, mix_sources(docs))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order, written as shards; the rows list the sequences."""
    return write_training_order(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("training_order", training_order),
]

# Scores of a trained network and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
