"""The corpus pipeline: documents through the operators of unitquarry.llm, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitquarry.llm import langid, mixing, packing, quality, simhash
from unitquarry.llm.queries import GOOD, quality_model
from unitquarry.runtime import checkpoint_ready


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    score = "_quality_score"
    scored = quality.with_score(docs, quality_model(spark, docs, sf_dir), score)
    return scored.filter(F.col(score) >= GOOD).drop(score)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts."""
    return simhash.keep_one(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def packing_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every document left."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_filter), ("language ID", language_filter),
    ("simhash near-dedup", near_duplicates), ("mixing sources", mixing_sources), ("packing", packing_batches)]

# Language models, SimHash and random rounding have no SQL counterpart; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are Parquet files in the checkpoint folder."""
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        at = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
