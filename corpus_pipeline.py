"""A training corpus from raw documents: drop toxic texts, near-duplicates and benchmark leaks, mix the sources, write token files."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import decontamination, mixing, orc_tokens, simhash, toxicity
from matchspark.llm.common import saved, shared_dir, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the network trained on the labelled rows among them."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicated(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus; the rows say where each document stands in them."""
    path = shared_dir(spark)
    orc_tokens.write_tokens(docs, path)
    return orc_tokens.token_index(spark, path)


STAGES = [("toxicity", toxic_out), ("near_duplicates", copies_out), ("decontamination", leaks_out), ("mixing", to_weights), ("tokens", token_files)]
ORACLE_SQL = None      # a trained network, fingerprints and a tokenizer are not SQL; tests/llm holds each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
