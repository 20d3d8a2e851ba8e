"""A training corpus from raw documents: language, exact copies, near copies, benchmark leaks, mixing weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from formline.llm import decontaminate, exact, langid, mixing, simhash
from formline.llm.common import table
from formline.llm.queries import TARGETS, label_domain
from formline.session import write_and_reload

#: Decisions of the stages rest on a fitted model and on hashes that SQL does not have; tests hold run() against brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near a centroid of some labelled language; texts without a letter go."""
    return langid.drop_rejected(docs, langid.fit(docs))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_exact_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def with_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate of each remaining document in the mix, with its tokens and posteriors."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), label_domain(), TARGETS)


STAGES = [
    ("language", known_language), ("exact", without_exact_copies), ("near", without_near_copies), ("benchmark", without_benchmark), ("mixing", with_rates),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_reload(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
