"""From raw documents to a training mix: each stage is one operator of perdura.llm.

Stages: toxic documents go; one document of each group of near copies stays; passages
of 300 bytes (about 50 words) that repeat are taken out of the texts; documents that hold
a benchmark passage go; the rest is mixed by source. A row's other columns come through
unchanged; extra columns, nulls and empty tables are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from perdura.llm import toxicity
from perdura.llm.decontaminate import clean_documents
from perdura.llm.mixing import mixed_documents
from perdura.llm.near_dedup import keep_one_of_each_group
from perdura.llm.suffix_dedup import without_passages
from perdura.plans.registry import query, table
from perdura.session import ship_package
from perdura.sources.staging import stage_table

PASSAGE = 300  # bytes, which 51 words with their spaces seldom fall short of; op9 has 400 by its contract


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one_of_each_group(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_passages(docs, PASSAGE)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken, with size, target and the number of copies the mix takes of each."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_by_source),
]

ORACLE_SQL = None  # the toxicity score is not a query; tests/llm holds the pipeline against brute force


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
