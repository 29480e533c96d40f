from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

WORDS = "the of and to rain stone river Lamp GREEN early über çela niño walks, reads. sleeps!".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.5 else "") for _ in range(n))


def make_texts():
    """Prose with copies, near copies, shared passages, repeats, odd spaces, nothing at all."""
    rng = random.Random(7)
    passage, line = sentence(rng, 40), sentence(rng, 14)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    texts += texts[:4] + [texts[5]] * 3
    for i in range(6, 14):
        words = (texts[i] + " " + passage).split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), passage + "\n" + texts[i], line + "\t" + texts[i]]
    texts += ["", "   \n\t ", "one", "One two three", "one  two three", passage, passage.upper(), "a" * 5000, "ab" * 400]
    texts += ["same words " * 60, "x\x0by\x0cz\rq", "é" * 60 + "ü" * 60, None, passage[:49], passage[:50], passage[:51]]
    texts += ["huge " + sentence(rng, 6000)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With extra columns named like outputs."""
    rows = [Row(doc_id=i * 3, text=t, lang="en", source="s", n_chars=len(t or ""), score=1, at=2, n=3, key="k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, at int, n int, key string").repartition(3)


@pytest.fixture(scope="session")
def by_id(texts):
    return {i * 3: t or "" for i, t in enumerate(texts)}


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def odd(spark):
    """NULL ids, repeated rows, and one id with two texts."""
    a, b = "p q r s t u v w x y z " * 3, " ".join(f"word{i}" for i in range(40))
    rows = [(None, a), (None, None), (1, b), (1, b), (2, b), (2, a), (5, a + b), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(i * 3, i % 2, int(t is not None and "stone" in t)) for i, t in enumerate(texts)]
    rows += [(None, 1, 1), (9999, 1, None), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
