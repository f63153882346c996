"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark decontamination, personal data, token ids.

Every stage works on all rows its predecessor kept. The first four return the columns of documents; n_chars follows the text where
a stage changes it. The last adds the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import decontamination, near_dedup, pii, quality_classifier, sentencepiece
from proofmill.llm.common import prepared, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    prepared(spark)
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8): the smallest id."""
    prepared(spark)
    return near_dedup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(prepared(spark), sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    prepared(spark)
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids and whether these decode to the text."""
    prepared(spark)
    return sentencepiece.encode(docs, memory_words=150_000, chunk_bytes=1_500_000, round_trip="round_trip")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("personal data", personal_data),
    ("token ids", token_ids),
]

#: Model fits, similarity classes, edit matching and tokenizers have no SQL form; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
