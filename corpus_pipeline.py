"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkgraph.llm import op01_mixing, op02_jaccard_join, op05_decontamination, op07_tokens, op10_quality
from larkgraph.llm.shared import Scratch, documents, small_batches

#: The last stage runs a tokenizer's vocabulary file, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects."""
    return op10_quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near-duplicates."""
    small_batches(spark)
    return op02_jaccard_join.deduplicate(docs, Scratch(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are contaminated by the benchmark's passages."""
    small_batches(spark)
    return op05_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources' words come near their targets."""
    return op01_mixing.mix_documents(docs, Scratch(spark, "pipeline-mix"))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids as ORC and returns each document's place, length and checksum in the files."""
    path = f"{Scratch(spark, 'pipeline-tokens').path}/tokens"
    op07_tokens.write_tokens(docs, path)
    return op07_tokens.report(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what its predecessor kept."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
