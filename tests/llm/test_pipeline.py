"""The stages in turn, each against what it has to do to its own input."""

from __future__ import annotations

import public_tokenizers as P
import pytest
from pyspark.sql import Row

import corpus_pipeline
from qagrade.llm import byte_bpe, toxicity
from qagrade.llm.common import stored
from tests.llm.test_duplicates import contained, joined


@pytest.fixture(scope="module")
def folder(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).union(
        spark.createDataFrame([Row(9001, "token=abcdefgh123 " + " ".join(f"u{i}" for i in range(60)), "en", "s", 1)], docs.select(columns).schema)
    ).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    items = [(i, " ".join((r.text or "").split()[:30])) for i, r in enumerate(docs.orderBy("doc_id").limit(3).collect())]
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "decontamination", "secrets", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, table, folder), name)
        before = texts(table)
        if name == "toxicity":
            scores = toxicity.toxicity(table, spark.read.parquet(f"{folder}/labels.parquet")).where("predicted = 0")
            assert set(texts(out)) == {r.doc_id for r in scores.collect()}
        elif name == "ngram_join":
            assert set(texts(out)) == {i for i, (_, c) in joined(before, 5, 80).items() if i == c}
        elif name == "decontamination":
            bad = {i for i, _ in contained(before, spark.read.parquet(f"{folder}/benchmark.parquet"))}
            assert set(texts(out)) == set(before) - bad
        elif name == "secrets":
            assert texts(out)[9001].startswith("[assign] u0") and set(texts(out)) == set(before)
        if name != "byte_bpe":
            assert out.columns == table.columns
        else:
            decoded = byte_bpe.decode(out, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
            assert {r.doc_id: bytes(r.decoded).decode() for r in decoded.collect()} == before
        table = out
    assert corpus_pipeline.run(spark, folder).count() == table.count() > 10


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_small_batches(spark, folder):
    """The stages' memory adds up in the workers; a number that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        for wanted, own in [(2 << 20, None), (2 << 20, 8 << 20), (3 << 20, 3 << 20)]:
            if own:
                spark.conf.set(key, str(own))
            corpus_pipeline.redact_secrets(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert spark.conf.get(key) == str(wanted)
    finally:
        spark.conf.set(key, before)
