"""Phrase mining and licence scans against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from qagrade.llm import collocations, licences
from qagrade.sources import scratch


def plain_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- phrases ----------------------------------------------------------------------------------


def pieces_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", plain_lower(text)):
        words = re.findall(r"[^\x20\x09]+", piece)
        if words:
            yield words


def brute_phrases(rows, least, best):
    found, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            total[lang] += len(words)
            counts = found.setdefault(lang, Counter())
            for n in range(1, 5):
                counts.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    for lang, counts in found.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in candidates.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    longer[p[i : i + n]] = max(longer.get(p[i : i + n], 0), a)
        kept = []
        for p, a in candidates.items():
            if 100 * longer.get(p, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:best], 1):
            yield lang, rank, p.decode(), -a, left, right, total[lang], -score


@pytest.mark.parametrize(("least", "best", "trigger"), [(3, 40, 2), (2, 100_000, 5), (8, 10, 32)])
def test_collocations_equal_brute_force(spark, texts, least, best, trigger):
    rng = random.Random(least)
    rows = [(rng.choice(["en", "fr", None, "und"]), t) for t in texts * 2]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"key": F.lit("x"), "f": F.lit(1), "n": F.lit(0)})
    got = collocations.collocations(docs.repartition(3), least, best, trigger)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    want = sorted(brute_phrases(rows, least, best))
    assert sorted(map(tuple, got.collect())) == want and want


def test_collocations_of_odd_tables(spark, odd, empty):
    """NULL languages and texts, repeated rows, one very long piece, nothing at all."""
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(odd.withColumn("lang", F.lit(None).cast("string")), best=3).columns[0] == "lang"
    long = "a " * 50_000 + "b"
    rows = [(None, long), (None, None), ("x", ""), (None, ". , ;"), ("y", "word " * 31), ("y", "word " * 31)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(brute_phrases(rows, 30, 2000))


def test_texts_of_phrases_are_read_from_one_part(spark, monkeypatch):
    """However many parts the dictionary has, each frequent phrase is read once, or little more often."""
    read, texts = [], collocations._texts

    def counted(*args):
        rows = texts(*args)
        read.append((rows.count(), rows.rdd.getNumPartitions()))
        return rows

    monkeypatch.setattr(collocations, "_texts", counted)
    rng = random.Random(8)
    rows = [("en", " ".join(rng.choice(["a b c", "d e", "f"]) for _ in range(20)) + f" own{i}") for i in range(400)]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.files.openCostInBytes": "256m"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        with scratch.scope():
            found = collocations.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(4), 30)
            (many, parts), = read
            assert parts > 4 and found.count() <= many < 1.1 * found.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_chunks_hold_every_phrase_once():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    doc, chunk, own = collocations.chunks(np.cumsum([0, *map(len, texts)]), data, 4)
    got = Counter()
    for d, c, n in zip(doc.tolist(), chunk.to_pylist(), own.tolist(), strict=True):
        words = c.split(" ")
        got.update((d, size, tuple(words[i : i + size])) for size in range(1, 5) for i in range(n) if i + size <= len(words))
    want = Counter()
    for d, text in enumerate(texts):
        words = text.split()
        want.update((d, size, tuple(words[i : i + size])) for size in range(1, 5) for i in range(len(words) - size + 1))
    assert got == want


def test_scores_of_huge_counts_are_exact(spark):
    a, left, right = 9_000_000_000_000_000_000, 9_000_000_000_000_000_001, 9_000_000_000_000_000_007
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(
        collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score")
    )
    assert row.first().score == 2_000_000 * a // (left + right)


# --- licences ---------------------------------------------------------------------------------

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licence_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain_lower(text))


def brute_base(text):
    words = licence_words(text)
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


def notices():
    templates = dict(reversed(licences.TEMPLATES))
    full = [text for _, text in licences.TEMPLATES]
    changed = full[2].replace("any person", "any human being").replace("charge", "all charges")
    rest = ["cc by cc by, CC-BY", "cc by", "all rights\nreserved. All rights reserved", "general public", "general Public LICENSE", "", None,
            "cc bü by", "ccé by", "x " * 5000 + "Licensed under CC BY-NC 4.0.", "the license of the software is the", "by"]
    assert templates
    return full + [changed, "before " + full[2] + " after " + full[4], *rest]


def test_licences_base_equals_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate([*notices(), *texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"label": F.lit(1), "score": F.lit("x")})
    got = {r.doc_id: r for r in licences.labelled(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and list(sorted(set(r.labels.split(",")))) == r.labels.split(",")
    for i, (label, _) in enumerate(licences.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1.0
    n = len(licences.TEMPLATES)
    assert got[n].labels == "mit" and 0.7 < got[n].score < 1
    assert got[n + 1].labels == "apache-2.0,mit"
    assert [got[n + 2 + i].labels for i in (0, 1, 9, 10)] == ["cc-by", "cc-by", "cc-by,cc-by-nc-4.0", ""]
    # a variant is not also what it is a variant of
    nc = next(i for i, (x, t) in enumerate(licences.TEMPLATES) if x == "cc-by-nc-4.0" and "Creative" in t)
    assert got[nc].labels == "cc-by-nc-4.0"


def test_licences_of_odd_tables(empty, odd):
    assert licences.labelled(empty).collect() == []
    rows = licences.labelled(odd).collect()
    assert len(rows) == 8 and all((r.n_base, r.first_word, r.labels, r.score) == (0, None, "", 0.0) for r in rows)
    assert sorted(r.n_words for r in rows)[:2] == [0, 0]


def test_matching_statistics_equal_brute_force():
    rng = random.Random(5)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 40))] for _ in range(6)]
    automaton = licences.SuffixAutomaton(sequences)
    runs: dict = {}
    for s, words in enumerate(sequences):
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                runs.setdefault(tuple(words[i:j]), set()).add((s, j))
    ends, state, length, text = automaton.ends(), 0, 0, [rng.randrange(5) for _ in range(400)]
    for i, word in enumerate(text):
        state, length = automaton.step(state, length, word)
        longest = max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0)
        assert length == longest
        if length:
            assert sorted(ends[state]) == sorted(runs[tuple(text[i + 1 - length : i + 1])])
