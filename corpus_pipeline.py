"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, token ids.

Every stage takes all that the one before kept and works on whole texts.  The first four return the
columns of their input: the quality classifier and the benchmark check take documents out, near-copy
removal keeps one document of each group, and suffix removal takes repeated passages out of texts.
The last returns the ids of each document.

SQL can't express the trees, the fingerprints and the merges, so there is none; tests hold the stages
against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import bpe, decontaminate, quality, queries, repeats, simhash
from pagemill.session import discard, stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.of_good_quality(docs, queries.table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written before the next reads it."""
    docs, kept = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if kept is not None:
            discard(kept)
        kept = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = queries.QUERIES | {"pipeline": run}
