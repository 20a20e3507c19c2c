"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import centroids, fingerprints, langid, licenses, mixing, packing, quality, setjoin, shards, suffixes, toxicity, tries, vectors
from seriesloom.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def registered(run: Run) -> Run:
    RUNS[run.__name__] = run
    return run


@registered
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), VOCABULARY)


@registered
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@registered
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.summary(table(spark, sf_dir, "documents"))


@registered
def op8_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.query_rows(table(spark, sf_dir, "documents"))


@registered
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@registered
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


SQL["op1_fingerprints"] = fingerprints.SQL


@registered
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


@registered
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"))


SQL["op5_repeats"] = suffixes.SQL
SQL["op8_near_documents"] = setjoin.SQL
SQL["op10_near_vectors"] = vectors.SQL


@registered
def op11_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.summary(table(spark, sf_dir, "documents"))


SQL["op11_shards"] = shards.SQL


@registered
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


SQL["op12_centroids"] = centroids.SQL


@registered
def op13_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.summary(table(spark, sf_dir, "conversations"))


SQL["op13_tries"] = tries.SQL
