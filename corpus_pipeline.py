"""The corpus pipeline: five stages over the table documents, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return
the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lontar.llm import ngram_join, packing, quality_classifier, quality_rules, secret_scan
from lontar.llm.common import scratch, small_batches, table


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is too low go; the model is fitted on the labelled ones among docs."""
    model = quality_classifier.train(docs, quality_classifier.graded(table(spark, sf_dir, "labels")))
    return quality_classifier.score(docs, model).filter("selected").select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or leave their compression band go."""
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 75 % of their 5-word shingles the one with the least id stays."""
    return ngram_join.one_of_each(docs)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; no document goes."""
    return secret_scan.redact(docs, length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and place of each document."""
    return packing.pack(docs)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality_classifier", _stage(quality_classifier_stage)),
    ("quality_rules", _stage(quality_rules_stage)),
    ("near_duplicates", _stage(near_duplicates_stage)),
    ("secret_scan", _stage(secret_scan_stage)),
    ("packing", _stage(packing_stage)),
]

#: Trained models and compression ratios are beyond SQL; the pipeline is held against a brute-force version in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
