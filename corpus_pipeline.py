"""The documents of a corpus made ready for training, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next stage's ``docs``. Low
quality goes, then toxic texts, then all but one document of each group of near copies, then passages that repeat; what is
left is tokenised and packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sojourn.llm import jaccard, packing, quality, repeats, toxicity
from sojourn.llm.scratch import staged


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.fit(docs, _labels(spark, sf_dir)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, _labels(spark, sf_dir)))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, size=5, percent=80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.kept_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return packing.pack(docs, f.read())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_copies", no_near_copies),
    ("repeats", no_repeats),
    ("packing", packed),
]

# The classifiers and the packing are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote on its way is deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
