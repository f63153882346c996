"""Registered queries of the training-data operators (their SQL is in oracles.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import alignment, decontamination, html_extract, near_dedup, packing, pii, prefix_trie, quality_classifier, quality_rules, sentencepiece, substring_dedup, toxicity, warc
from proofmill.llm.common import prepared, table
from proofmill.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def register(fn):
        QUERIES[key] = lambda spark, folder: fn(prepared(spark), folder)
        return fn

    return register


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the test items its text holds, and whether it stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_matches(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_items"), F.col("matches.item_id").alias("item_ids"),
                        F.col("matches.distance").alias("distances"), (F.size("matches") == 0).alias("kept"))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op10_pii")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, and all spans."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its piece ids, their number, and whether decoding them gives the text back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sentencepiece.encode(docs, round_trip="round_trip").select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


@query("op9_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the size of its set of two-word shingles, its component, and whether it stays."""
    found = near_dedup.near_duplicates(table(spark, folder, "documents"), shingle_words=2)
    return found.withColumnRenamed("id", "doc_id")


@query("op1_quality_classifier")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its evidence, its site's prior, the posterior and whether it stays."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    found = quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, folder, "labels")))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("evidence", "prior", "posterior")), "kept")


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: the base counts, the base rule, the verdict of the weighed votes and its posterior."""
    voted = quality_rules.stored_votes(table(spark, folder, "documents"))
    found = quality_rules.judge(voted, quality_rules.fit(voted))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@query("op5_warc")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: its record as the archives give it back."""
    archives = warc.write_archives(table(spark, folder, "pages"), warc.archive_folder(spark))
    found = warc.read_archives(spark, archives)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


@query("op8_substring_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its words, those removed, and the digest of what is left."""
    found = substring_dedup.repeated_passages(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: whether it is held out of training, its score, and the prediction."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"), allowed=remainder != 1)
    found = found.withColumnRenamed("row_id", "doc_id")
    return found.select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted")


@query("op7_html_extraction")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: its main text and the text's length."""
    return html_extract.extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Per piece of a document: its tokens, and its place in a sequence."""
    return packing.pack(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op12_prefix_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Per node of the conversations' prefix trie: its members, children and leaves, and the tokens that sharing saves."""
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query("op13_alignment")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: tokens of both tokenizers, their groups and links, and what the links count in the whole table."""
    return alignment.align(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
