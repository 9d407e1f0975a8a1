"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sojourn.llm import bpe, chats, jaccard, licenses, manifest, outliers, packing, quality, repeats, rollups, sketches, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        return packing.pack(table(spark, sf_dir, "documents"), f.read())


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judged(table(spark, sf_dir, "documents"))


@query
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.as_files(table(spark, sf_dir, "documents")))


@query
def op10_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.corpus_totals(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors))


@query
def op12_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.checked_conversations(chats.with_tricky(table(spark, sf_dir, "conversations")))


@query
def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.without_newlines(table(spark, sf_dir, "documents"))


ORACLES["op10_token_totals"] = rollups.CORPUS_SQL
ORACLES["op12_chats"] = chats.CHAT_SQL
ORACLES["op13_manifest"] = manifest.MANIFEST_SQL
