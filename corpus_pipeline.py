"""Corpus pipeline: quality rules, quality classifier, near-duplicates, packing.

Each stage takes what its predecessor kept, whole, and its decisions take effect.

For all stages: a null text is an empty one; a null doc_id is a value like others; rows that repeat an id are
judged each by their own text; columns beyond those of ``documents`` are carried on, whatever they are called, by all but the last;
an empty table gives an empty result of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import classifier, near_copies, packing, quality_rules
from tessera.llm.common import bound_batches, table, written


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the certified cutoffs reject go; an empty text has too few words and goes.

    Languages without a certified cutoff, a null one among them, are held to the base rules."""
    return quality_rules.rejected_removed(docs, table(spark, sf_dir, "labels"))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the cutoff go; where no model can be fitted, as without labels, all stay."""
    bound_batches(spark)
    return classifier.rejected_removed(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id.

    Near duplicates share 0.8 or more of their five-word shingles; fingerprints find the candidates.  Rows without an id stay;
    different texts that share an id and no group all stay."""
    bound_batches(spark)
    return near_copies.near_copies_removed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids: what a trainer reads.  An empty text is one piece, the end mark."""
    bound_batches(spark)
    return packing.pack(docs, keep_store=False)


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_dedup", simhash_stage),
    ("packing", packing_stage),
]
#: fingerprints by XXH64, a fitted model and a tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))  # once, as stages read their input more than once
    return STAGES[-1][1](spark, docs, sf_dir)
