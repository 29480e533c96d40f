from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators import parse

FIELDS = ("context", "relevance", "answer", "groundness", "utility")


def parsed(spark, outputs):
    rows = [(i, o) for i, o in enumerate(outputs)]
    df = parse.parse_tagged(spark.createDataFrame(rows, "i int, output string"))
    return [tuple(r[f] for f in FIELDS) for r in df.orderBy("i").collect()]


def expected(output):
    """The rules of the survey, stated once more in Python."""
    if output is None or not output.startswith("[Retrieval]"):
        return (None,) * 5
    before, opened, tail = output.partition("<paragraph>")
    inside, closed, after = tail.partition("</paragraph>")
    context = inside.strip() if opened and closed else None
    rest = (after if context is not None else output.removeprefix("[Retrieval]")).strip()
    relevance = next((t for t in ("[Relevant]", "[Irrelevant]") if rest.startswith(t)), None)
    rest = rest.removeprefix(relevance or "").strip()
    hits = sorted((rest.index(t), t) for t in V.GROUNDNESS_TOKENS + V.UTILITY_TOKENS if t in rest)
    if not hits:
        return context, relevance, rest, None, None
    at, token = hits[0]
    answer, later = rest[:at].strip(), rest[at + len(token) :]
    grounded = relevance == "[Relevant]" and token in V.GROUNDNESS_TOKENS
    utility = None
    if grounded:
        utility = min((t for t in V.UTILITY_TOKENS if t in later), default=None)
    elif relevance and token in V.UTILITY_TOKENS:
        utility = token
    return context, relevance, answer, token if grounded else None, utility


@pytest.mark.parametrize(
    ("output", "fields"),
    [
        (
            "[Retrieval]<paragraph>Some context</paragraph>[Relevant]Answer text[Fully supported][Utility:3]",
            ("Some context", "[Relevant]", "Answer text", "[Fully supported]", "[Utility:3]"),
        ),
        # lowest number after groundness, not the first position
        (
            "[Retrieval]<paragraph>c</paragraph>[Relevant]a[Partially supported][Utility:5][Utility:2]",
            ("c", "[Relevant]", "a", "[Partially supported]", "[Utility:2]"),
        ),
        # utility first: groundness after it is ignored
        (
            "[Retrieval]<paragraph>c</paragraph>[Relevant]a[Utility:4][Fully supported]",
            ("c", "[Relevant]", "a", None, "[Utility:4]"),
        ),
        # irrelevant with groundness first has neither
        ("[Retrieval]<paragraph>c</paragraph>[Irrelevant]a[Fully supported][Utility:2]", ("c", "[Irrelevant]", "a", None, None)),
        ("[Retrieval]<paragraph>c</paragraph>[Irrelevant]a[Utility:2]", ("c", "[Irrelevant]", "a", None, "[Utility:2]")),
        # no relevance token: the answer is still cut
        ("[Retrieval]<paragraph>c</paragraph>a[Fully supported][Utility:2]", ("c", None, "a", None, None)),
        # no paragraph, empty paragraph, unclosed paragraph
        ("[Retrieval][Relevant]a[Utility:1]", (None, "[Relevant]", "a", None, "[Utility:1]")),
        ("[Retrieval]x<paragraph></paragraph>[Relevant][Utility:1]", ("", "[Relevant]", "", None, "[Utility:1]")),
        ("[Retrieval]<paragraph>c[Relevant]a", (None, None, "<paragraph>c[Relevant]a", None, None)),
        # first pair counts; a close before the open does not
        ("[Retrieval]</paragraph><paragraph>c</paragraph>a<paragraph>d</paragraph>", ("c", None, "a<paragraph>d</paragraph>", None, None)),
        ("[Retrieval]<paragraph>a\nb　</paragraph>\n[Relevant] x \n[Utility:1]", ("a\nb", "[Relevant]", "x", None, "[Utility:1]")),
        ("[Retrieval]<paragraph>c</paragraph>[Relevant]a[Utility:6]", ("c", "[Relevant]", "a[Utility:6]", None, None)),
        ("[Retrieval]", (None, None, "", None, None)),
        (" [Retrieval]<paragraph>c</paragraph>[Relevant]a", (None,) * 5),
        ("", (None,) * 5),
        (None, (None,) * 5),
    ],
)
def test_rules(spark, output, fields):
    assert parsed(spark, [output]) == [fields]
    assert expected(output) == fields


def test_random_outputs_follow_the_rules(spark):
    rnd = random.Random(7)
    bits = [
        *V.GROUNDNESS_TOKENS, *V.UTILITY_TOKENS, *V.RELEVANCE_TOKENS, "[Utility:", "[No support/Contradictory]",
        "<paragraph>", "</paragraph>", " ", "\n", " ", "a", "é𝄞", "[", "]", "$1", "\\", "[Retrieval]",
    ]
    outputs = []
    for _ in range(1500):
        lead = rnd.choice(["[Retrieval]", "[Retrieval]<paragraph>c </paragraph>", "[Retrieval]<paragraph>c</paragraph>[Relevant]"])
        outputs.append(lead + "".join(rnd.choice(bits) for _ in range(rnd.randrange(9))))
    assert parsed(spark, outputs) == [expected(o) for o in outputs]


def test_pieces_agree_with_the_whole(spark):
    outputs = [
        "[Retrieval]<paragraph> c </paragraph> [Relevant] a [Fully supported] [Utility:3][Utility:1]",
        "[Retrieval][Irrelevant]a[Utility:2]",
        "[Retrieval]<paragraph>c</paragraph>plain",
    ]
    df = spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "i int, output string")
    steps = df.withColumn("remainder", parse.parse_remainder(F.col("output")))
    steps = steps.withColumn("relevance", parse.extract_relevance(F.col("remainder")))
    steps = steps.withColumn("body", parse.answer_body(F.col("remainder")))
    body, relevance = F.col("body"), F.col("relevance")
    rows = steps.select(
        parse.extract_context(F.col("output")).alias("context"),
        "relevance",
        parse.extract_answer(body).alias("answer"),
        parse.extract_groundness(body, relevance).alias("groundness"),
        parse.extract_utility(body, relevance).alias("utility"),
        parse.first_token(body).alias("first"),
    ).collect()
    assert [tuple(r[f] for f in FIELDS) for r in rows] == parsed(spark, outputs)
    assert [r["first"] and tuple(r["first"]) for r in rows] == [("[Fully supported]", 3), ("[Utility:2]", 2), None]


def test_gate(spark):
    outputs = {
        "[Retrieval]a": True,
        " [Retrieval]a": False,
        "[Retrieval]a[No Retrieval]": False,
        "[Retrieval]a[Continue to Use Evidence]b": False,
        "[retrieval]a": False,
        None: None,
    }
    df = spark.createDataFrame([(o,) for o in outputs], "output string")
    assert {r.output: r.keep for r in df.select("output", parse.retrieval_gate(F.col("output")).alias("keep")).collect()} == outputs


def test_process_dataset_keeps_other_columns(spark):
    rows = [("[Retrieval]<paragraph>c</paragraph>[Relevant]a[Utility:1]", "old", 1), ("x", "old", 2), (None, "old", 3)]
    df = spark.createDataFrame(rows, "output string, context string, other int")
    out = parse.process_dataset(df)
    assert out.columns == ["output", "context", "other", "relevance", "answer", "groundness", "utility"]
    assert [(r.context, r.other) for r in out.collect()] == [("c", 1)]
    assert "output" not in parse.process_dataset(df, remove_output=True).columns


def test_audit_counts(spark):
    rows = [("[Retrieval]a",), ("[No Retrieval]",), ("[Retrieval][Continue to Use Evidence]",), (None,), ("b",)]
    audit = parse.filter_audit(spark.createDataFrame(rows, "output string")).first().asDict()
    assert audit == {
        "rows_before": 5, "rows_after": 1, "null_output": 1, "no_retrieval": 1, "continues_evidence": 1, "not_leading": 2,
    }
