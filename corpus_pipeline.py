"""Documents to clean, distinct, tokenised training text, stage by stage.

`run` writes each stage's rows to the shared folder and reads them again as the next one's
documents. All stages but the last keep the columns of `documents`. Rows with a NULL text pass
every filter; rows with a NULL id are judged by their texts, but count for no group of near copies. An
empty table passes through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from qagrade.llm import byte_bpe, contamination, ngram_join, secrets, toxicity
from qagrade.llm.common import discard, documents, ship_stage, stored
from qagrade.sources.scratch import scoped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    ship_stage(spark)
    return toxicity.without_toxic(docs, documents(spark, sf_dir, "labels"))


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by 5-word shingles and a similarity of 0.8."""
    ship_stage(spark)
    return ngram_join.without_similar(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    ship_stage(spark)
    return contamination.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With secrets replaced by their kinds."""
    ship_stage(spark)
    return secrets.redact(docs, size_column="n_chars")


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each text, little-endian unsigned 32-bit, in place of the text."""
    ship_stage(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_similar),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode_texts),
]

#: The stages are models, components and codecs: tests hold them against brute force instead.
ORACLE_SQL = None


@scoped
def _stored_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage: Callable) -> DataFrame:
    """A stage's rows as a table; what the stage kept meanwhile is deleted."""
    return stored(stage(spark, docs, sf_dir), name)


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, _stored_stage(spark, docs, sf_dir, name, stage)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
