"""A training corpus from ``documents``: five stages, each written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from widemargin.llm import decontamination, mixing, ngram_jaccard, pii, quality
from widemargin.llm.common import table
from widemargin.session import ensure_checkpoint_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  It learns from the labelled rows of ``docs``."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return ngram_jaccard.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are masked, terms that reveal them removed or generalised."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with size, source_size, target, copies and taken."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [("quality", good), ("near_duplicates", unlike), ("decontamination", clean), ("pii", private), ("mixing", mixed)]

#: Compression, alignment and the sanitised texts have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return done
        done.write.parquet(path := f"{folder}/{number}_{name}")
        docs = spark.read.schema(done.schema).parquet(path)


PIPELINE = {"pipeline": run}
