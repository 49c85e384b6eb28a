"""A corpus pipeline of five stages, each the whole of its predecessor's output.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame. All but the last return the columns of documents. The pipeline has no
SQL equivalent (a trained classifier and a tokenizer are in it); its tests compare it
with plain versions of its stages. Empty tables pass through all stages; documents may
have further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveline.llm import decontaminate, near_duplicates, packing, quality, suffix_dedup
from waveline.llm.common import Scratch

#: Bytes of a repeated string: 51 words of spoken English have about 255.
REPEAT_BYTES = 240


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking puts above the cut; null and empty texts are judged like any other."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; those without a word or an id stay."""
    return near_duplicates.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without the passages that occur more than once; null texts stay null."""
    return suffix_dedup.clean(docs, REPEAT_BYTES)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them; those without a word stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences; an empty text is its end token."""
    return packing.pack(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, suffix_array_dedup, benchmark_decontamination, best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for _, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
