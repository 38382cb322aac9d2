"""From raw documents to a mix: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stewardry.llm.decontaminate import drop_contaminated
from stewardry.llm.exact_dedup import drop_exact_copies
from stewardry.llm.jaccard import keep_one_of_each
from stewardry.llm.mixing import MIX, mixing_rates, quality_domains
from stewardry.llm.toxicity import drop_toxic
from stewardry.session import fresh_dir, remove, scratch, ship, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic."""
    ship(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without whitespace, one stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share four fifths of their five-word shingles, directly or by others, the document of the smallest id stays."""
    ship(spark)
    return keep_one_of_each(docs, shingle=5, similar=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    ship(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left, with the rate at which it enters the mix."""
    ship(spark)
    return mixing_rates(docs, quality_domains(table(spark, sf_dir, "labels")), MIX, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near duplicates", near), ("decontamination", decontaminate), ("mixing", mix)]

#: The toxicity models can't be told in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`, each written as Parquet and read again. What a stage has written meanwhile goes with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_dir(spark, f"pipeline-{k}")
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
