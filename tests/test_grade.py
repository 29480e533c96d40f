from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators import grade

WHOLE = (
    "<think>\nt\n</think>\n<answer>a</answer> <contextual-relevance>[Relevant]</contextual-relevance>"
    "<answer-utility>[Utility:4]</answer-utility>\n<groundness>[Fully supported]</groundness>\n"
)


def evaluate(spark, rows, schema, **columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return df.orderBy("i").select(*[c.alias(n) for n, c in columns.items()]).collect()


def test_two_of_five_tags(spark):
    text = "<think>...</think><answer>...</answer>"
    scores = grade.grade_structure(spark.createDataFrame([(text,)], "generation string")).first()
    assert [scores[m] for m in V.STRUCTURE_METRICS] == [1.0, 1.0, 0.0, 0.0, 0.0]
    assert scores["overall_structure_score"] == 0.4


def structure(text):
    return [float(text.count(f"<{t}>") == 1 and text.count(f"</{t}>") == 1) for t in V.TAGS]


def in_order(text):
    body = r"\s*".join(f"<{t}>.*?</{t}>" for t in V.TAGS)
    return float(sum(structure(text)) == 5 and bool(re.fullmatch(rf"\s*{body}\s*", text, re.DOTALL)))


def test_random_texts(spark):
    rnd = random.Random(11)
    tags = [f"<{t}>" for t in V.TAGS] + [f"</{t}>" for t in V.TAGS]
    pairs = [f"<{t}>x</{t}>" for t in V.TAGS]
    texts = ["".join(rnd.choice([*tags, *pairs, " ", "y", "<", "<answer"]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    texts += [rnd.choice(["", "\n", "z"]).join(pairs) for _ in range(40)]
    texts += ["".join(rnd.sample(pairs, 5)) for _ in range(40)] + [WHOLE, ""]
    rows = evaluate(
        spark,
        [(t,) for t in texts],
        "g string",
        order=grade.structure_order(F.col("g")),
        mean=grade.structure_score(F.col("g")),
        **{f"s{i}": grade.tag_structure(F.col("g"), t) for i, t in enumerate(V.TAGS)},
    )
    for text, row in zip(texts, rows):
        assert [row[f"s{i}"] for i in range(5)] == structure(text), text
        assert row["mean"] == sum(structure(text)) / 5
        assert row["order"] == in_order(text), text
    assert {r["order"] for r in rows} == {0.0, 1.0}


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("This is [Utility:3]", "3"),
        ("[Utility:12]x[Utility:1]", "12"),
        ("[Utility:007]", "7"),
        ("Utility:5", "0"),
        ("[Utility:]", "0"),
        ("[Utility:٣]", "0"),
        ("[Utility:99999999999999999999999]", "9" * 23),
        ("", "0"),
        (None, "0"),
    ],
)
def test_utility_value(spark, text, number):
    assert evaluate(spark, [(text,)], "s string", v=grade.utility_value(F.col("s")))[0].v == number


@pytest.mark.parametrize(
    ("extracted", "expected", "plain", "reward"),
    [
        ("[Utility:4]", "[Utility:4]", 1.0, 1.0),
        ("[Utility:5]", "[Utility:4]", 0.75, 0.75),
        ("[Utility:1]", "[Utility:5]", 0.0, 0.0),
        ("[Utility:12]", "[Utility:4]", 0.0, 0.0),
        ("[Utility:99999999999999999999999]", "[Utility:4]", 0.0, 0.0),
        ("no number", "[Utility:4]", 0.0, 0.0),
        # expected without a number: it counts as 0 in the one, and any token will do in the other
        ("[Utility:1]", "unknown", 0.75, 1.0),
        ("[Utility:4]", "unknown", 0.0, 1.0),
        ("Utility:5", "unknown", 0.0, 1.0),
        ("[Utility:12]", "unknown", 0.0, 1.0),
        ("[Utility:9]", "unknown", 0.0, 0.0),
        ("[Utility:0]", "[Utility:0]", 0.0, 0.0),
        ("", "[Utility:4]", 0.0, 0.0),
        ("[Utility:4]", "", 0.0, 0.0),
        ("[Utility:4]", None, 0.0, 0.0),
        (None, "[Utility:4]", 0.0, 0.0),
    ],
)
def test_utility_grades(spark, extracted, expected, plain, reward):
    got, label = F.col("a"), F.col("b")
    row = evaluate(
        spark,
        [(extracted, expected)],
        "a string, b string",
        plain=grade.utility_grade(got, label),
        reward=grade.utility_grade_reward(got, label),
    )[0]
    assert (row.plain, row.reward) == (plain, reward)


@pytest.mark.parametrize(
    ("extracted", "expected", "strict", "normalized"),
    [
        ("[Relevant]", " [Relevant]\n", 1.0, 1.0),
        ("[relevant]", "[Relevant]", 0.0, 0.0),
        (V.NO_SUPPORT_PROMPT, V.NO_SUPPORT, 0.0, 1.0),
        (V.NO_SUPPORT, V.NO_SUPPORT, 1.0, 1.0),
        ("", "", 0.0, 0.0),
        (" ", "\n", 1.0, 1.0),
        (None, "[Relevant]", 0.0, 0.0),
        ("[Relevant]", None, 0.0, 0.0),
    ],
)
def test_token_grades(spark, extracted, expected, strict, normalized):
    got, label = F.col("a"), F.col("b")
    row = evaluate(
        spark,
        [(extracted, expected)],
        "a string, b string",
        relevance=grade.relevance_grade(got, label),
        strict=grade.groundness_grade(got, label),
        normalized=grade.groundness_grade(got, label, normalize_slash=True),
    )[0]
    assert (row.relevance, row.strict, row.normalized) == (strict, strict, normalized)


def test_grade_generations(spark):
    rows = [
        (1, "m", 0, WHOLE, "[Relevant]", "[Utility:5]", None),
        (2, "m", 0, None, "[Relevant]", "[Utility:5]", "[Fully supported]"),
    ]
    df = spark.createDataFrame(
        rows, "row_id long, model string, sample int, generation string, relevance string, utility string, groundness string"
    )
    verdicts = spark.createDataFrame(
        [(1, "m", 0, "answer_correctness", 0.5), (1, "m", 0, "faithfulness", 1.0)],
        "row_id long, model string, sample int, metric string, score double",
    )
    one, two = grade.grade_generations(df, verdicts).orderBy("row_id").collect()
    assert [one[m] for m in V.STRUCTURE_METRICS] == [1.0] * 5
    assert (one.relevance_correct, one.utility_correct, one.groundness_correct) == (1.0, 0.75, 0.0)
    assert (one.answer_correctness, one.faithfulness, one.answer_relevancy, one.judged) == (0.5, 1.0, None, 2)
    assert one.content_score == pytest.approx((1 + 0.75 + 0 + 0.5) / 4)
    assert one.overall_score == (1.0 + one.content_score) / 2
    assert (two.overall_structure_score, two.content_score, two.overall_score, two.judged) == (0.0, 0.0, 0.0, 0)
