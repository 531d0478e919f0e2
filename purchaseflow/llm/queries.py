"""The registered queries of the training-data operators, with their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (ann, bpe, conversations, fingerprints, jaccard, licenses, lm, merkle, packing, quality,
               substrings, token_counts, toxicity)
from .common import table

VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document by its labelled neighbours."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens; one row per piece."""
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of ids and decoded text."""
    return bpe.token_digests(bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document by the counts of all documents."""
    return lm.scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that occur earlier."""
    return substrings.kept_digests(substrings.deduplicated(table(spark, sf_dir, "documents")))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that each document's text or lines name."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 85 % alike."""
    return jaccard.components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document by a convolutional classifier."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after known damage."""
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked against a tampered copy."""
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), *merkle.tampered()))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and which are over 512 tokens."""
    return token_counts.with_limit(token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY)))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_fingerprints": op2_fingerprints,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_lm": op5_lm,
    "op6_substrings": op6_substrings,
    "op7_licenses": op7_licenses,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_ann": op10_ann,
    "op11_conversations": op11_conversations,
    "op12_merkle": op12_merkle,
    "op13_token_counts": op13_token_counts,
}

# Vocabularies and trained models cannot be reached from SQL: see tests/llm for those.
ORACLES: dict[str, str] = {
    "op5_lm": lm.ORACLE_SQL,
    "op7_licenses": licenses.ORACLE_SQL,
}
