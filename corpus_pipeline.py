"""Documents made ready for training: poor, toxic and repeated ones go, sources are mixed, and the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomweb.llm.common import Scratch, table
from loomweb.llm.mixing import repeated
from loomweb.llm.ngram_join import one_of_each
from loomweb.llm.packing import pack
from loomweb.llm.quality import score_quality
from loomweb.llm.toxicity import score_toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    return score_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3).where("good = 1").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.7."""
    return score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7).where("toxic = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree by 0.8 or more."""
    return one_of_each(docs, k=5, similarity="0.8")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 5, 2, 1 takes them."""
    return repeated(docs, weights=(5, 2, 1), most=3.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bins of 2048 words, no text twice and no source over four times in one."""
    return pack(docs, capacity=2048, per_source=4)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Neither the classifiers nor the packing can be put into SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
