from __future__ import annotations

import sys

import pytest
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import clip, strip, tag_content, tag_count


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_strip_removes_what_python_strips(spark):
    blanks = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c).isspace()]
    assert sorted(V.WHITESPACE) == sorted(blanks)
    rows = [(f"{b}a{b}b{b}",) for b in blanks] + [("​x",), ("",), (None,)]
    got = [r.v for r in spark.createDataFrame(rows, "s string").coalesce(1).select(strip(F.col("s")).alias("v")).collect()]
    assert got == [None if s is None else s.strip() for (s,) in rows]


@pytest.mark.parametrize(
    ("text", "tag", "expected"),
    [
        ("<answer>Earth</answer>", "answer", "Earth"),
        ("<think>Reasoning</think>", "think", "Reasoning"),
        ("<think>\n two\nlines \n</think>", "think", "two\nlines"),
        ("<answer>a</answer><answer>b</answer>", "answer", "a"),
        ("</answer><answer>a</answer>", "answer", "a"),
        ("<answer>never closed", "answer", ""),
        ("<answer-utility>x</answer-utility>", "answer", ""),
        ("", "answer", ""),
    ],
)
def test_tag_content(spark, text, tag, expected):
    assert value(spark, tag_content(F.lit(text), tag)) == expected


def test_tag_count(spark):
    text = F.lit("<answer>a</answer><answer-utility></answer></answer-utility>")
    assert value(spark, tag_count(text, "<answer>")) == 1
    assert value(spark, tag_count(text, "</answer>")) == 2
    assert value(spark, tag_count(text, "<answer-utility>")) == 1
    assert value(spark, tag_count(text, "<think>")) == 0


def test_clip(spark):
    assert value(spark, clip(F.lit("abcd"), 4)) == "abcd"
    assert value(spark, clip(F.lit("abcde"), 4)) == "abcd..."


def test_long_text(spark):
    text = F.concat(F.lit("<answer>"), F.repeat(F.lit("ab\n<"), 500_000), F.lit("</answer>"))
    assert value(spark, F.length(tag_content(text, "answer"))) == 2_000_000
