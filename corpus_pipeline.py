"""From raw documents to packed sequences: five stages, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.neardup import without_near_duplicates
from meterflow.llm.packing import pack
from meterflow.llm.secrets import labelled_strings, redact
from meterflow.llm.secrets import train as train_secrets
from meterflow.llm.templates import without_benchmark
from meterflow.llm.toxicity import fit, without_toxic
from meterflow.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7 under a model of the labelled folds that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return without_toxic(docs, fit(docs, learnt), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return without_near_duplicates(docs, 75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact(docs, train_secrets(labelled_strings(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, mixed by source."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: Trained models, component search and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
