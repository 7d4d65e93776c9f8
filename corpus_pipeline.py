"""A training corpus from raw documents: rule out poor ones, near copies and benchmark passages, mix sources, write token ids.

Each stage takes ``(spark, docs, sf_dir)``: the rows that the stage before it kept, and the folder of the other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import decontaminate, entropy_mix, jaccard_join, quality_rules, token_files
from riskloom.llm.common import written
from riskloom.llm.queries import table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return entropy_mix.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and where each document's ids stand in them."""
    return token_files.read_segments(token_files.write_segments(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_files", write_tokens),
]

#: The near-duplicate groups, the learned quality and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
