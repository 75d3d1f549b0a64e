"""A corpus pipeline: five stages, each one operator over all that the stage before it kept.

``run`` writes every stage's result to the session's shared folder and reads it
back, so that lineage is cut and a lost executor costs one stage at most. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintage.llm import decontamination, jaccard_join, packing, pii, toxicity
from vintage.llm.common import materialise, read_table
from vintage.llm.queries import word_bpe


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier predicts as toxic go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id stays."""
    return jaccard_join.keep_one_per_group(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text gives way to the kind in angle brackets, and ``n_chars``, where there is one, follows."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training windows."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL has no byte-pair encoding and no Zstandard; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = materialise(stage(spark, out, sf_dir), f"pipeline-{name}")
    return out
