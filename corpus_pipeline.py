"""From raw documents to token ids: the filters of a training corpus, one after another.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All stages but
the last return the columns of ``documents``. A stage's rows are written and read again before
the next one starts, so that a lost executor never costs more than a stage. What a stage has staged
for itself, and the rows of the stage before it, are deleted once its rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meibo.llm import decontaminate, exact_dedup, ngram_join, sentencepiece_viterbi, toxicity
from meibo.llm.ship import ship
from meibo.operators.staging import discard, discarding, new_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from labelled documents of this input, doesn't reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.model_for(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    ship(spark)
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return ngram_join.drop_near_copies(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    ship(spark)
    return sentencepiece_viterbi.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece", encoded),
]

#: Trained models, similarity groups and piece searches have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with discarding(spark):
            step(spark, docs, sf_dir).write.parquet(path)
        # What the stage before wrote has been read.
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
