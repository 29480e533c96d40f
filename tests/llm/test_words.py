"""Words, hashes and anchors against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from qagrade.llm.anchors import anchor_places
from qagrade.llm.common import LONG_WORD, WORD, Words, key_filter, shingle_sets, slices


def test_words_of_slices(texts):
    for limit in (1, 300, 1 << 20):
        seen = []
        for row, end, offsets, data in slices(pa.array(texts), limit):
            words, raw = Words(offsets, data), data.tobytes()
            own = [[] for _ in range(end - row)]
            for d, a, b in zip(words.doc, words.start, words.end, strict=True):
                own[d].append(raw[a:b].decode())
            seen += own
        assert seen == [re.findall(WORD, t or "") for t in texts]


def test_hashes_depend_on_the_word_alone():
    long = "y" * (LONG_WORD + 5)
    words = Words(*_slice(["a bc " + long, "bc a", long]))
    h = words.hashes
    assert h[0] == h[4] and h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 3


def _slice(texts):
    return next(slices(pa.array(texts)))[2:]


def test_shingles_of_few_words():
    sets = [s for _, s in shingle_sets(Words(*_slice(["a b c", "a b c d", "a b c d a b c d", "", "a b c"])), 4)]
    assert [len(s) for s in sets] == [1, 1, 4, 0, 1] and sets[0] == sets[4] and sets[1][0] in sets[2]


@pytest.mark.parametrize("width", [1, 2, 5, 9])
def test_anchors_are_least_of_a_window(width):
    rng = np.random.default_rng(0)
    for n in (0, 1, 8, 60):
        h = rng.integers(1, 6, n).astype(np.uint64)
        inside = rng.random(max(n - width + 1, 0)) < 0.7
        want = {j for i in np.flatnonzero(inside) for j in range(i, i + width) if h[j] == h[i : i + width].min()}
        assert set(anchor_places(h, width, inside).tolist()) == want


def test_key_filter_passes_its_keys_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63, 5000)
    keys[:4] = [0, -1, 2**63 - 1, -(2**63)]
    own = key_filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert own.passes(keys.view(np.uint64)).all()
    others = rng.integers(0, 2**63, 100_000).view(np.uint64)
    assert own.passes(others).mean() < 0.001
    none = key_filter(spark.createDataFrame([], "key long"))
    assert not none.passes(others).any()
