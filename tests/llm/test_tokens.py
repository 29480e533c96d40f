"""Byte-level BPE and token files against the public libraries."""

from __future__ import annotations

import hashlib
import json
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from qagrade.llm import byte_bpe, token_files

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    keys = [b"%d" % i for i in range(1000)]
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(1000))
    assert sorted(table.slot) == list(range(1000))


def test_random_texts(library):
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), P.PATTERN)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", " \n", "\t", "'s", "'ll", "12", "é", "中", "#", "!!", "😀", "the", "\x1c", "aaaa" * 20]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_round_trip_query(docs, by_id, library):
    for row in byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        ids = np.array(library.encode_ordinary(by_id[row.doc_id]), "<u4")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(by_id[row.doc_id].encode()).hexdigest()


def test_encode_keeps_columns(docs, by_id, empty, odd):
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert out.columns == [*docs.columns, "ids", "n_tokens", "decoded"]
    assert all(bytes(r.decoded).decode() == by_id[r.doc_id] for r in out.collect())
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    assert byte_bpe.round_trip(odd, RANKS, P.PATTERN).count() == odd.count()


def test_token_files(docs, by_id):
    model = Tokenizer.from_file(WORDS)
    rows = token_files.with_crc32(token_files.files_round_trip(docs, WORDS, 2)).collect()
    start = 0
    for row in sorted(rows, key=lambda r: r.doc_id):
        ids = np.array([*model.encode(by_id[row.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(by_id)


def test_token_files_have_the_ids_of_added_tokens(spark):
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>B", "<|ENDOFTEXT|> x", "plain"]
    model = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.files_round_trip(docs, WORDS, 2).collect()}
    assert rows == {i: [*model.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert rows[0] == [1883, 49407, 997, 2]


READER = """
import sys, zlib
from pyspark.sql import SparkSession
from qagrade.llm.token_files import read_files

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for row in read_files(spark, sys.argv[1]).orderBy("start").collect():
    print(row.doc_id, row.start, row.n_tokens, zlib.crc32(row.ids))
"""


def test_token_files_can_be_read_in_another_session(docs, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_files(token_files.encoded(docs, WORDS, 2), path)
    here = token_files.with_crc32(token_files.read_files(docs.sparkSession, path)).collect()
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"PYTHONPATH": root}
    there = subprocess.run([sys.executable, "-c", READER, path], env=env, check=True, timeout=300, capture_output=True, text=True).stdout
    rows = [tuple(map(int, line.split())) for line in there.splitlines()]
    assert sorted(rows) == sorted(map(tuple, here)) and len(rows) == len(here) > 0


def test_token_files_of_odd_tables(empty, odd):
    assert token_files.files_round_trip(empty, WORDS, 2).count() == 0
    rows = token_files.files_round_trip(odd, WORDS, 2).collect()
    assert len(rows) == odd.count()
    assert sorted(r.start for r in rows)[0] == 0 and len({r.start for r in rows}) == len(rows)


def test_cached_tokenizer_is_the_library():
    with open(WORDS, encoding="utf-8") as lines:
        file = lines.read()
    cached, model = token_files.CachedTokenizer(file, "<u2"), Tokenizer.from_str(file)
    rng = random.Random(2)
    parts = ["a", "B", " ", "\n", "\x7f", "'s", "'LL", "1", "é", "É", "!!", "😀", "́", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|end", "oftext|>", "Σ", "İ", "क़", "\xa0", "½", "\x1d", "||"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert np.frombuffer(cached.encode([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids


def test_letters_go_to_the_model_alone():
    """Stretches of plain letters need no normal form and no splits; a file that changes letters does."""
    with open(WORDS, encoding="utf-8") as lines:
        file = lines.read()
    cached, model, rng = token_files.CachedTokenizer(file, "<u2"), Tokenizer.from_str(file), random.Random(4)
    asked = []
    cached.model = type("Asked", (), {"encode_batch_fast": lambda self, x, **k: asked.extend(x) or model.encode_batch_fast(x, **k)})()
    words = ["".join(rng.choices("abzéßÿðaeiou", k=rng.randint(1, 14))) for _ in range(500)]
    text = " ".join([*words, "Upper ÉTÉ", *(w + ".,;!" for w in words)])
    assert np.frombuffer(cached.encode([text])[0], "<u2").tolist() == model.encode(text, add_special_tokens=False).ids
    assert not any(w in x.split() for x in asked for w in words)
    changed = json.loads(file)
    changed["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "zz"}, "content": "y"})
    assert token_files.CachedTokenizer(json.dumps(changed), "<u2").letters is None


def test_runs_are_kept_without_their_space(library):
    """Runs that stand at a text's start, behind a space and at its end have their own ids."""
    codec = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), P.PATTERN)
    for text in ["walks walks", "walks", "a walks, a", "a ", "x" * 70 + " " + "x" * 70, "Lamp42 Lamp42 42"] * 2:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert "walks" in codec.runs and " walks" not in codec.runs


def test_memos_hold_a_word_once(library):
    """A run's first pre-token is the run without its signs, and kept as that alone; odd patterns are split as before."""
    codec, rng = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), P.PATTERN), random.Random(8)
    words = [w + s for w in ("zwalkz", "Lampq", "été", "x" * 70, "'s", "#!", "12") for s in ("", ",", "'s", "9.", "\u3000a", "\x1c")]
    for text in [" ".join(rng.choices(words, k=9)) for _ in range(300)]:
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)
    assert "zwalkz" in codec.runs and not any(p[0] == " " and p[1:] in codec.runs for p in codec.pieces)
    plain = byte_bpe.Codec(codec.tokens, r"[a-z]+", codec.perfect)
    for text in ("ab 12 cd, ab", "ab cd1e cd1e ab1 1"):
        assert plain.encode(text) == b"".join([plain.piece(p) for p in plain.split(text)])


def test_ids_leave_in_small_batches():
    """A large batch of texts is encoded some rows at once, so neither its ids nor its strings are held whole."""
    codec, rng = byte_bpe.Codec(byte_bpe.read_ranks(RANKS), P.PATTERN), random.Random(9)
    texts = [None, "", *("word " * rng.randint(0, 9000) for _ in range(80)), "long " * 200_000, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array(["cut", *texts])], ["doc_id", "text"]).slice(1)
    parts = list(byte_bpe._encoded(codec, batch, "text"))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(1, len(texts) + 1))
    assert [x for p in parts for x in p.column(2).to_pylist()] == [codec.encode(t or "") for t in texts]
    assert [n for p in parts for n in p.column(3).to_pylist()] == [len(codec.encode(t or "")) // 4 for t in texts]
    assert len(parts) > 3 and all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1 << 19 for p in parts)
    assert list(byte_bpe._encoded(codec, batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("n,limit", [(0, 16), (1, 16), (2, 16), (50, 6), (3000, 12), (64, 6)])
def test_code(n, limit):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 5, np.int64)
    counts[:n] = np.maximum(1, rng.pareto(0.3, n)).clip(1, 10**12)
    lengths = token_files.code_lengths(counts, limit)
    assert (lengths[:n] > 0).all() and not lengths[n:].any() and lengths.max(initial=0) <= limit
    if n > 1:
        assert sum(2.0 ** -lengths[:n]) == 1.0
    if n:
        code = token_files.Code(lengths)
        ids = rng.integers(0, n, 1000)
        payload, offsets = code.pack(ids)
        assert code.unpack(payload, offsets, 1000).tolist() == ids.tolist()


def test_columns_are_encoded_by_their_distinct_stretches():
    """A column's stretches are looked up once each, plain letters by the merges alone, and its ids are the library's."""
    with open(WORDS, encoding="utf-8") as lines:
        file = lines.read()
    cached, model, rng = token_files.CachedTokenizer(file, "<u2"), Tokenizer.from_str(file), random.Random(6)
    parts = ["Lamp", "lamp.", "ÉTÉ", "été,", "W̊", "<|endoftext|>", "\xa0", "İx", "Ÿ", "a\x7fb", "\x1d", "\x0b", "x" * 300 + ".", " ", "\n "]
    texts = [None, "", " ", *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(600)), "lamp " * 5000]
    asked = []
    learn = cached._learn
    cached._learn = lambda new: asked.extend(new) or learn(new)
    column = pa.array(["left out", *texts]).slice(1)
    got = cached.encode_column(column, b"\x02\x00")
    ids = [np.frombuffer(x, "<u2").tolist() for x in got.to_pylist()]
    assert ids == [[*model.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert len(asked) == len(set(asked)) and "left" not in asked
    assert cached.encode_column(column.slice(0, 0)).to_pylist() == []
    assert not any(len(x) > 256 for x in cached.memo)
