"""Shingle join, decontamination and the two substring operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qagrade.llm import anchors, contamination, ngram_join, queries, statements, substrings, suffixes
from qagrade.llm.common import WORD, key_filter
from qagrade.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return re.findall(WORD, text)


def shingles(text, k):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def joined(by_id, k, percent):
    sets = {i: shingles(t.encode().translate(LOWER).decode(), k) for i, t in by_id.items()}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_ngram_join(docs, by_id, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs, k, percent).collect()}
    assert got == joined(by_id, k, percent)


def test_ngram_join_links_what_no_hub_reaches(spark):
    """A family in which most pairs are too far apart: chains and late comers."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    by_id = {}
    for i in range(60):
        by_id[i] = " ".join(base)
        base[rng.randrange(80)] = f"new{i}"
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(spark.createDataFrame(list(by_id.items()), "doc_id long, text string")).collect()}
    assert got == joined(by_id, 4, 85)


def test_without_similar_loses_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, b, "x"), (2, b, "y"), (2, a, "z"), (3, a + " more", "u"), (3, a + " more", "u"), (None, b, "n"), (None, None, "n"), (4, None, "e"), (4, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set string")
    left = sorted(map(tuple, ngram_join.without_similar(docs).collect()), key=str)
    # the row of id 2 with a text of its own stays, and the rows without words
    assert left == sorted([rows[0], rows[2], *rows[5:]], key=str)
    again = [(7, a, "u"), (7, a, "v"), (8, a, "w")]
    left = ngram_join.without_similar(spark.createDataFrame(again, "doc_id long, text string, set string")).collect()
    assert sorted(r.set for r in left) == ["u", "v"]


def test_ngram_join_of_families_that_share_a_passage(spark, monkeypatch):
    """Families of near copies with a passage in common, more partners than one task takes."""
    monkeypatch.setattr(ngram_join, "PARTNERS", 4)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(12)]
    by_id = {}
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(40)]
        for member in range(25):
            own = list(base)
            own[rng.randrange(40)] = f"x{member % 9}"
            by_id[len(by_id)] = " ".join(own[:20] + passage + own[20:])
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs).collect()}
    assert got == joined(by_id, 4, 85)


def test_texts_are_not_shuffled(spark, docs):
    """Copies are told by filters: of the texts, only rows that may go are joined."""
    rows = ngram_join.without_similar(docs, 5, 80)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "MapInArrow" in plan.split("LeftAnti")[1].split("Relation")[0]
    everything = docs.select(F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    assert ngram_join._without(docs, everything).count() == 0
    assert sorted(r.doc_id for r in ngram_join._without(docs, everything.where("_id % 2 = 0")).collect()) == [
        r.doc_id for r in docs.where("doc_id % 2 = 1").orderBy("doc_id").collect()
    ]
    none = ngram_join._without(docs, everything.withColumn("_hash", F.lit(0).cast("long")))
    assert none.schema == docs.schema and none.count() == docs.count()


def test_ranks_of_tuples_follow_their_parts():
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(62), rng.integers(-3, 3, 500), rng.integers(0, 2, 500)]
    tuples = list(zip(*(p.tolist() for p in parts), strict=True))
    place = {t: i for i, t in enumerate(sorted(set(tuples)))}
    for n in (1, 2, 3):
        own = [t[:n] for t in tuples]
        order = {t: i for i, t in enumerate(sorted(set(own)))}
        assert suffixes._named(*parts[:n]).tolist() == [order[t] for t in own]
    assert suffixes._named(*parts, *parts, *parts).tolist() == [place[t] for t in tuples]
    left, right = rng.integers(0, 9, 40), rng.integers(0, 9, 30)
    a, b = suffixes._merge_places([left], [right])
    assert a.tolist() == [(right < x).sum() for x in left] and b.tolist() == [(left <= x).sum() for x in right]


def test_ngram_join_of_odd_tables(empty, odd):
    assert ngram_join.similar(empty).count() == 0
    rows = ngram_join.similar(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert {r.component_id for r in rows if r.doc_id == 1} == {1}
    assert {r.component_id for r in rows if r.doc_id == 2} == {1, 2}
    kept = ngram_join.without_similar(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 2


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: y for x, y in label.items() if any(a != b and x in (a, b) for a, b in pairs)}


def cut_words(by_id):
    least = {}
    runs = lambda w: [tuple(w[i : i + 13]) for i in range(len(w) - 12)]
    for i in sorted(by_id):
        for r in runs(words(by_id[i])):
            least.setdefault(r, i)
    out = {}
    for i, t in by_id.items():
        w = words(t)
        gone = {p + j for p, r in enumerate(runs(w)) if least[r] < i for j in range(13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, by_id):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == cut_words(by_id)


def test_substrings_of_a_family(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    by_id = {}
    for i in range(40):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = rng.choice(["x", f"y{i}"])
        by_id[i] = " ".join(own[rng.randint(0, 40) : rng.randint(120, 200)] * rng.randint(1, 2))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digests(docs).collect()}
    assert got == cut_words(by_id)


def test_substrings_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (2, "x " + a), (3, "y z " + b)], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substrings.digests(docs).collect()} == {1: (60, 0), 2: (61, 60), 3: (62, 60)}


def cut_bytes(by_id):
    least = {}
    for i in sorted(by_id):
        t = by_id[i].encode()
        for p in range(len(t) - 49):
            least.setdefault(t[p : p + 50], i)
    out = {}
    for i, t in by_id.items():
        t = t.encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def suffix_rows(docs):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digests(docs).collect()}


def test_suffixes(docs, by_id):
    assert suffix_rows(docs) == cut_bytes(by_id)


def test_suffixes_of_a_family(spark, monkeypatch):
    """Anchors in so many contexts that several tasks share them."""
    monkeypatch.setattr(suffixes, "GROUP", 8)
    rng = random.Random(4)
    middle = "".join(rng.choice("abcd ") for _ in range(90))
    tail = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 70)))
    by_id = {i: tail() + middle[rng.randint(0, 30) : rng.randint(60, 90)] + tail() for i in range(80)}
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert suffix_rows(docs) == cut_bytes(by_id)


SYLLABLES = "the and ing ou re ha on er in th st an es ea ble or at ti nd sh".split()


def syllables(rng, n):
    return "".join(rng.choice(SYLLABLES) + " " * (rng.random() < 0.3) for _ in range(n))


def test_suffix_anchors_depend_on_their_string_alone():
    rng = random.Random(11)
    texts = [syllables(rng, 400), "ab" * 90, "a" * 70, "é" * 60, syllables(rng, 12) * 9, "", "x" * 49, "y" * 50]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    doc, at, key = suffixes.find_anchors(offsets, np.frombuffer(b"".join(raw), np.uint8))
    own = {}
    for d, p, k in zip(doc.tolist(), at.tolist(), key.tolist(), strict=True):
        assert p + suffixes.ANCHOR <= len(raw[d])
        own.setdefault(d, {})[p] = k
    wanted, keys = {}, {}
    for d, t in enumerate(raw):
        for p in range(len(t) - 49):
            _, (place,), (k,) = suffixes.find_anchors(np.array([0, 50]), np.frombuffer(t[p : p + 50], np.uint8))
            assert own[d][p + place] == k
            assert keys.setdefault(t[p + place : p + place + suffixes.ANCHOR], k) == k
            wanted.setdefault(d, set()).add(p + place)
    assert {d: set(x) for d, x in own.items()} == wanted  # and no other
    assert len(set(keys.values())) == len(keys)
    assert len(own[0]) < len(raw[0]) / 12


def test_suffixes_compare_no_strings_equal_by_chance(spark, monkeypatch):
    """Short strings that many texts share by chance bring no contexts: else these outgrow the input."""
    rng = random.Random(12)
    by_id = {i: "".join(rng.choice(("th", "an", "er", "in")) for _ in range(2500)) for i in range(40)}
    by_id[40] = by_id[3][500:700] + by_id[36][900:980]
    short = [{t[p : p + 16] for p in range(len(t) - 15)} for t in by_id.values()]
    assert sum(map(len, short)) > 1.05 * len(set().union(*short))
    compared, real = [], suffixes._with_bytes
    monkeypatch.setattr(suffixes, "_with_bytes", lambda docs, contexts: compared.append(contexts.count()) or real(docs, contexts))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert suffix_rows(docs) == cut_bytes(by_id)
    assert compared[0] < 30


@pytest.mark.parametrize("most,shuffles", [(2, 2), (1, 4)])
def test_ids_of_copies_go_to_the_tasks(spark, monkeypatch, most, shuffles):
    """Else the anchors are dealt once more, by their documents."""
    plans, real = [], anchors.stored
    monkeypatch.setattr(anchors, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or real(df, name))
    monkeypatch.setattr(anchors, "COPIES", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_id = {i: syllables(random.Random(i % 3), 60) + "end " * (i == 4) for i in range(5)}
        docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
        copied = anchors.copies(docs)
        assert {r.doc_id for r in copied.collect()} == {3}
        more = spark.createDataFrame([(3,), (77,)], "doc_id long")
        found = anchors.shared_anchors(docs, suffixes.find_anchors, more, suffixes._context_columns, "ctx long, start int, before int, size int")
        assert {r.doc_id for r in found.collect()} == {0, 1, 4}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (plan,) = [p for name, p in plans if name == "places"]
    assert plan.partition("== Physical Plan ==")[2].count("Exchange hashpartitioning") == shuffles


def test_shuffles_are_freed_as_steps_end(spark):
    name = anchors._CLEANUP
    before = spark.conf.get(name, None)
    with pytest.raises(ValueError), anchors.freed(spark):
        assert spark.conf.get(name) == "true"
        raise ValueError
    assert spark.conf.get(name, None) == before


def test_sorted_strings():
    rng = random.Random(3)
    for letters in (b"a", b"ab", b"ab c", bytes(range(256))):
        base = bytes(rng.choice(letters) for _ in range(200))
        texts = [base[a : a + rng.randint(50, 84)] for a in (rng.randint(0, 116) for _ in range(40))]
        row, at, number = suffixes.sorted_strings(texts)
        assert sorted(zip(row, at, strict=True)) == [(i, p) for i, t in enumerate(texts) for p in range(len(t) - 49)]
        ends = [texts[i][p:].ljust(90, b"\0") for i, p in zip(row, at, strict=True)]
        assert ends == sorted(ends)
        assert [a[:50] == b[:50] for a, b in zip(ends, ends[1:], strict=False)] == (number[1:] == number[:-1]).tolist()


def test_screened_contexts_are_those_that_can_share_a_string():
    rng = random.Random(8)
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    seed, far = letters(16), letters(34)
    for left in range(35):
        # the first two share `left` bytes before their anchor and so many behind it that one string is equal
        one, two = letters(34 - left) + far[34 - left :] + seed, letters(34 - left) + far[34 - left :] + seed
        tail = letters(34 - left)
        texts = [one + tail + letters(left), two + tail + letters(left), letters(34) + seed + far]
        # others share half of their bytes on one side alone, or have little of it
        texts += [far + seed + letters(34), letters(12) + far[12:] + seed + letters(34), far[-20:] + letters(14) + seed]
        own = [{t[p : p + 50] for p in range(len(t) - 49)} for t in texts]
        start = np.array([34, 34, 34, 34, 34, 34], np.int32)
        kept = suffixes._screened(start, pa.array(texts, pa.binary()))
        for i, x in enumerate(own):
            assert kept[i] or not any(x & y for j, y in enumerate(own) if j != i)
        assert kept[:2].all() and not kept[2]
    some = [letters(17) + far[17:] + seed + letters(34) for _ in range(4)]  # 33 equal bytes
    assert not suffixes._screened(np.full(4, 34, np.int32), pa.array([b"x", *some], pa.binary()).slice(1)).any()


def test_suffixes_compare_the_first_documents_of_contexts(spark, monkeypatch):
    """An anchor whose contexts all have one first document has nothing to sort."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    seed = letters(60)
    first = letters(80) + seed + letters(200) + seed + letters(80)
    by_id = {1: first, 2: letters(90) + first[:200] + letters(70), 3: letters(300)}
    compared, real = [], suffixes._with_bytes
    monkeypatch.setattr(suffixes, "_with_bytes", lambda docs, contexts: compared.append(contexts.collect()) or real(docs, contexts))
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    assert suffix_rows(docs) == cut_bytes(by_id)
    several = {}
    for r in compared[0]:
        several.setdefault(r.key, set()).add(r.lo)
    assert all(len(x) > 1 for x in several.values())


@pytest.mark.parametrize("run,size", [(substrings.digests, "n_words"), (suffixes.digests, "n_bytes")])
def test_substrings_of_odd_tables(empty, odd, run, size):
    assert run(empty).count() == 0
    rows = run(odd).collect()
    assert len(rows) == odd.count()
    assert not any(r.n_removed for r in rows if r.doc_id in (None, 1))
    assert sorted(r.n_removed for r in rows if r.doc_id == 2)[0] == 0
    assert any(r.n_removed == r[size] > 0 for r in rows if r.doc_id == 2)
    assert max(r.n_removed for r in rows if r.doc_id == 5) > 0


@pytest.fixture(scope="module")
def benchmark(spark, by_id):
    texts = [by_id[i] for i in sorted(by_id)]
    items = [" ".join(words(t)[3:40]) for t in texts[:12]] + ["one", "one two three", "", None, "not in there at all no no no"]
    return spark.createDataFrame(list(enumerate(items)), "item_id int, text string")


def contained(by_id, benchmark):
    out = set()
    for item in benchmark.collect():
        k = min(len(words((item.text or "").lower())), 5)
        own = shingles((item.text or "").lower(), k) if k else ()
        for i, t in by_id.items():
            # an item of fewer than five words is one run of so many
            if own and len(words(t)) >= k and len(own & shingles(t.lower(), k)) >= 0.8 * len(own):
                out.add((i, item.item_id))
    return out


def test_contamination(docs, by_id, benchmark):
    got = [(r.doc_id, r.item_id) for r in contamination.contaminated(docs, benchmark).collect()]
    want = contained(by_id, benchmark)
    assert sorted(got) == sorted(want) and len(want) > 5
    left = contamination.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == set(by_id) - {i for i, _ in got}


def test_contamination_finds_short_items_inside_documents(spark):
    texts = ["the Capital of France is a big city", "capital", "of France", "capital of\nfrance", "the capitals of France", "", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[3])], "doc_id long, text string")
    items = ["capital of France", "CAPITAL", "big city", "of france is a big", " ", None, "is a big city"]
    benchmark = spark.createDataFrame([*enumerate(items), (1, items[1])], "item_id int, text string")
    got = sorted((tuple(r) for r in contamination.contaminated(docs, benchmark).collect()), key=str)
    runs = [(0, 0), (0, 1), (0, 2), (0, 6), (1, 1), (3, 0), (3, 1), (0, 3)]
    want = [(d, i) for d, i in runs if d == 0] * 2 + [x for x in runs if x[0]] + [(None, 0), (None, 1)]
    want += [(d, i) for d, i in want if i == 1]  # the item stands twice
    assert got == sorted(((d, i, 1, 1, 1.0) for d, i in want), key=str)
    left = contamination.decontaminated(docs, benchmark.where("item_id <> 1"))
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 4, 5, 6]


def test_contamination_finds_every_small_item(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(400)) for _ in range(10)]
    items = [" ".join(t.split()[p : p + rng.randint(5, 20)]) for t in texts for p in range(0, 360, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.contaminated(docs, benchmark).collect()}
    assert got == contained(dict(enumerate(texts)), benchmark) and len(got) == len(items)


def test_contamination_of_odd_tables(docs, empty, odd, benchmark):
    assert contamination.contaminated(empty, benchmark).count() == 0
    assert contamination.contaminated(docs, benchmark.limit(0)).count() == 0
    assert contamination.decontaminated(odd, benchmark).count() == odd.count()
    one = benchmark.selectExpr("0 AS item_id", "'word3 word4' AS text").limit(1)
    # rows go by their own texts, whatever their ids
    left = contamination.decontaminated(odd, one).collect()
    assert sorted(((r.doc_id, (r.text or "")[:4]) for r in left), key=str) == [(2, "p q "), (5, ""), (None, ""), (None, "p q ")]


def test_contamination_statement_with_short_items(spark, tmp_path):
    texts = ["the Capital of France is a big city", "capital of france", "a b c d e f g h i", "b c\td  e", None, ""]
    items = ["capital of France", "b c d e", "a b c d e f g x", "  ", None, "city"]
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(statements.SQL["op5_contamination"])
    got = queries.QUERIES["op5_contamination"](spark, str(tmp_path)).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and [r[:2] for r in rows] == [(0, 0), (0, 5), (1, 0), (2, 1), (3, 1)]


@pytest.mark.parametrize("name", sorted(statements.SQL))
def test_statements(spark, sf_dir, name):
    import __spark_entry__ as driver

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(driver.oracle_sql()[name])
    df = driver.queries()[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_only_shared_prefix_shingles_are_shuffled(spark):
    """A filter of the groups' leads, then one of shingles that occur twice: what is left is what groups share."""
    prefixes = {1: [11, 12, 13], 2: [13, 14], 3: [15, -16, 17], 4: [-16, 18]}
    rows = [(g, d, d, len(p), p) for g, p in prefixes.items() for d in (10 * g, 10 * g + 1, 10 * g + 1)]
    real = spark.createDataFrame(rows, "grp long, doc_id long, set long, n long, prefix array<long>").repartition(3)
    leads = spark.createDataFrame([(g, 10 * g + 1, 10 * g + 1) for g in prefixes], "grp long, doc_id long, set long")
    key = F.xxhash64("grp", "doc_id", "set").alias("key")
    lead = spark.sparkContext.broadcast(key_filter(leads.select(key)))
    wanted = spark.sparkContext.broadcast(key_filter(spark.createDataFrame([(13,), (-16,)], "key long")))
    rows = real.select("grp", "n", "prefix", key)
    # two equal rows lead each group
    assert sorted(r.token for r in ngram_join._tokens(rows, lead).collect()) == sorted(2 * sum(prefixes.values(), []))
    shared = [(1, 3, 2, 13), (2, 2, 0, 13), (3, 3, 1, -16), (4, 2, 0, -16)]
    passing = ngram_join._tokens(rows, lead, wanted)
    assert sorted(map(tuple, passing.collect())) == sorted(2 * shared)
    once = ngram_join._postings(real.dropDuplicates(["grp", "doc_id"]), leads)
    assert sorted(map(tuple, once.select("grp", "n", "at", "token").collect())) == sorted(shared)
    twice = ngram_join._postings(real, leads).where("token IN (13, -16)")
    assert sorted(map(tuple, twice.collect())) == sorted(shared)


def test_compared_sets_travel_as_texts(spark):
    """The sets of pairs are stored and dealt as texts; what is compared is made from them in the task."""
    rng = random.Random(9)
    base = [f"W{i}" for i in range(160)]
    by_id = {i: " ".join([*(f"x{i}y{j}" for j in range(i)), *base[i:]]) for i in range(0, 60, 4)} | {99: "other words", 100: None}
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    base_rows = ngram_join._prefixes(docs, 4, 85).where("n > 0").select("doc_id", "set")
    sets = ngram_join._set_texts(docs, base_rows.where("doc_id <> 99").select("doc_id"), 4)
    assert dict(sets.dtypes) == {"set": "bigint", "text": "string"}
    of = {r.set: r.doc_id for r in base_rows.collect()}
    assert {of[r.set]: r.text for r in sets.collect() if of[r.set] < 99} == {i: t for i, t in by_id.items() if i < 99}
    ids = sorted(x for x in of.values() if x < 99)
    name = {d: s for s, d in of.items()}
    pairs = [(name[a], name[b]) for a in ids for b in ids if a < b and rng.random() < 0.7]
    found = ngram_join._compared(spark.createDataFrame(pairs, "a long, b long"), sets, 4, 85)
    own = {i: shingles(t.lower(), 4) for i, t in by_id.items() if t}
    want = {(a, b) for a, b in pairs if 100 * len(own[of[a]] & own[of[b]]) >= 85 * len(own[of[a]] | own[of[b]])}
    assert {(r.a, r.b) for r in found.collect()} == want and 0 < len(want) < len(pairs)
