"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

Each function takes (spark, docs, sf_dir), and its result is written as Parquet and reread as the next one's docs. All but
the last return the columns of ``documents``. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calltrace.functions.work import materialize
from calltrace.llm import decontamination, mixing, ngram_join, token_output, toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects by the threshold of their language go. Trained on the labels of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train(docs, labels))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document stays."""
    return ngram_join.one_of_each_class(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; a document taken twice is two rows."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows' token ids are written as shards; returns where each row lies in them."""
    return token_output.token_output(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("token_output", token_ids),
]

#: The stages' models and sketches have no SQL form; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
