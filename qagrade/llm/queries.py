"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qagrade.llm import byte_bpe, collocations, contamination, language_model, licences, merkle, ngram_join, quality, secrets, substrings, suffixes, token_files, toxicity
from qagrade.llm.common import documents
from qagrade.llm.statements import SQL


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every document."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are similar."""
    return ngram_join.similar(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secrets.digests(documents(spark, sf_dir))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the word runs that a document with a smaller id has too."""
    return substrings.digests(documents(spark, sf_dir))


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item."""
    return contamination.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree and word-table log probabilities of every document."""
    return language_model.scored(documents(spark, sf_dir))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document with a smaller id has too."""
    return suffixes.digests(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-level BPE ids of every document, written as Huffman-coded blocks and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.with_crc32(token_files.files_round_trip(documents(spark, sf_dir), path, 2))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts and the log-ratio verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-or toxicity of every document, with the sentences that offend."""
    return toxicity.toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and the outcome of its trial for every document."""
    return merkle.verified(documents(spark, sf_dir))


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and the best covered notice of every document."""
    return licences.labelled(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words belong together most."""
    return collocations.collocations(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_join": op2_ngram_join,
    "op3_secrets": op3_secrets,
    "op4_substrings": op4_substrings,
    "op5_contamination": op5_contamination,
    "op6_language_model": op6_language_model,
    "op7_suffixes": op7_suffixes,
    "op8_token_files": op8_token_files,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_licences": op12_licences,
    "op13_collocations": op13_collocations,
}

__all__ = ["QUERIES", "SQL"]
