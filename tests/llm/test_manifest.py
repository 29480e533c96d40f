"""The Merkle manifest against a tree built in memory."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from qagrade.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return out


def leaf_of(row, text):
    fields = (*row[:4], text)
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields)


def brute_force(rows):
    by: dict = {}
    for row in rows:
        by.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by[s]])
    top = levels([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, (_, _, leaf, row) in enumerate(by[s]):
            proof = siblings(trees[s], i) + siblings(top, k)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf_of(row, row[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            for left, right in proof:
                node = digest([*left, node, *right])
            whole = digest(x for left, right in proof for x in (*left, *right))
            yield row[0], leaf, trees[s][-1][0], top[-1][0], whole, node, node == top[-1][0]


@pytest.mark.parametrize(("n", "sources"), [(0, 1), (1, 1), (40, 3), (5000, 1), (400, 300)])
def test_manifest_equals_a_tree_in_memory(spark, n, sources):
    """NULL ids, sources and texts, repeated ids and rows, a hot source, one lone leaf, no rows."""
    rng = random.Random(n)
    rows = [
        (
            None if rng.random() < 0.02 else rng.randrange(10**6),
            None if rng.random() < 0.05 else "hot" if rng.random() < 0.5 else f"é{rng.randrange(sources)}",
            "en", i, rng.choice(["Ab", "ab", None, "", "ÉA"]),
        )
        for i in range(n)
    ]
    rows += rows[: n // 10]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "root": F.lit(1), "pos": F.lit(None)})
    got = merkle.verified(docs.repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_force(rows), key=str)


def test_nodes_whose_last_neighbour_is_ragged(spark):
    """More than 16 blocks, of which the last node holds fewer than the others: partners get its root."""
    blocks = [(7, b, f"{b:04d}") for b in range(16 * 3 + 5)]
    state = spark.createDataFrame(blocks, "tree long, block long, root string").withColumns(
        {"blocks": F.lit(len(blocks)).cast("long"), "levels": F.array().cast(merkle._LEVELS)}
    )
    for width in (1, 16):
        state = merkle._swapped(state, width)
    tree = levels([root for *_, root in blocks])
    rows = {r.block: r for r in state.collect()}
    assert len(rows) == len(blocks) and {r.root for r in rows.values()} == {tree[-1][0]}
    for b, row in rows.items():
        assert [(x.l, x.r) for x in row.levels] == [("".join(a), "".join(c)) for a, c in siblings(tree, b)]


def test_manifest_keeps_the_proofs(docs, by_id):
    rows = merkle.manifest(docs).collect()
    assert len(rows) == len(by_id)
    for r in rows:
        node = r.leaf
        for level in r.levels:
            node = digest([level.l, node, level.r])
        assert node == r.root
