"""Grades of tagged generations against their labels.

Grade functions are column expressions from 0.0 to 1.0. A generation that is NULL counts as
an empty text. ``grade_generations`` reads the text twice: once for the list of tags, once
for the four tag contents.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import is_missing, sorted_tags, stands_once, strip, tag_content, tags_found
from qagrade.operators.judge import attach_judge

_TAIL = 18  # digits that a BIGINT always holds
_IN_ORDER = [marker for tag in V.TAGS for marker in (f"<{tag}>", f"</{tag}>")]
_BLANKS = f"[{V.WHITESPACE}]*"
_ONLY_BLANKS_OUTSIDE = (
    f"(?s)\\A{_BLANKS}" + _BLANKS.join(f"<{tag}>.*?</{tag}>" for tag in V.TAGS) + f"{_BLANKS}\\z"
)


def _score(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _paired(tags: Column, tag: str) -> Column:
    return stands_once(tags, f"<{tag}>") & stands_once(tags, f"</{tag}>")


def tag_structure(text: Column, tag: str) -> Column:
    """1.0 if the tag opens once and closes once, wherever."""
    return _score(_paired(sorted_tags(text), tag))


def _mean_structure(scores: list[Column]) -> Column:
    return sum(scores[1:], scores[0]) / F.lit(float(len(scores)))


def structure_score(text: Column) -> Column:
    """Mean structure score of the five tags.

    The tags are collected once: ``transform`` over a one-element array gives the list a name.
    """
    mean = F.transform(F.array(sorted_tags(text)), lambda tags: _mean_structure([_score(_paired(tags, t)) for t in V.TAGS]))
    return F.get(mean, F.lit(0))


def structure_order(text: Column) -> Column:
    """1.0 if all tags are there once, in order, with only whitespace outside."""
    in_order = tags_found(text) == F.array(*[F.lit(m) for m in _IN_ORDER])
    return F.when(in_order, _score(text.rlike(_ONLY_BLANKS_OUTSIDE))).otherwise(0.0)


def utility_value(text: Column) -> Column:
    """N of the first ``[Utility:N]`` with ASCII digits, 0 without one.

    It is text without leading zeros, so that a number of any length is exact.
    """
    marked = F.concat(F.coalesce(text, F.lit("")), F.lit("[Utility:0]"))
    return F.regexp_extract(marked, r"\[Utility:0*([0-9]+)\]", 1)


def _next_number(digits: Column) -> Column:
    """The number after the one that the digits name; that after no digits is 1."""
    head = F.rtrim(digits, F.lit("9"))
    last = F.coalesce(F.right(head, F.lit(1)).try_cast("int"), F.lit(0)) + 1
    kept = F.substring(head, F.lit(1), F.greatest(F.length(head) - 1, F.lit(0)))
    return F.concat(kept, last.cast("string"), F.repeat(F.lit("0"), F.length(digits) - F.length(head)))


def _distance(a: Column, b: Column) -> Column:
    """How far two numbers in digits are apart; 4 for 4 and more."""
    a_first = (F.length(a) > F.length(b)) | ((F.length(a) == F.length(b)) & (a > b))
    more, less = F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)
    head = lambda x: F.substring(x, F.lit(1), F.greatest(F.length(x) - _TAIL, F.lit(0)))
    tail = lambda x: F.right(x, F.lit(_TAIL)).cast("bigint")
    apart = tail(more) - tail(less)
    near = F.when(head(more) == head(less), apart).when(head(more) == _next_number(head(less)), apart + 10**_TAIL)
    return F.least(F.coalesce(near, F.lit(4)), F.lit(4))


def _closeness(got: Column, wanted: Column) -> Column:
    # ``transform`` over one element keeps the digits' arithmetic out of the row's generated code,
    # which would grow beyond what the JVM compiles
    pair = F.array(F.struct(got.alias("a"), wanted.alias("b")))
    apart = F.get(F.transform(pair, lambda p: _distance(p["a"], p["b"])), F.lit(0))
    return F.lit(1.0) - apart / F.lit(4.0)


def utility_grade(
    extracted: Column, expected: Column, got: Column | None = None, wanted: Column | None = None
) -> Column:
    """One minus a quarter per step apart; 0.0 for missing texts or an unreadable extracted one.

    An expected text without a number counts as the number 0. ``got`` and ``wanted`` are the
    :func:`utility_value` of the two texts, for callers that have them as columns.
    """
    got = utility_value(extracted) if got is None else got
    wanted = utility_value(expected) if wanted is None else wanted
    ungraded = is_missing(extracted) | is_missing(expected) | (got == "0")
    return F.when(ungraded, 0.0).otherwise(_closeness(got, wanted))


def utility_grade_reward(
    extracted: Column, expected: Column, got: Column | None = None, wanted: Column | None = None
) -> Column:
    """As :func:`utility_grade`, but with another rule for an expected text without a number.

    There any extracted text that holds ``Utility:1`` to ``Utility:5`` earns 1.0.
    """
    got = utility_value(extracted) if got is None else got
    wanted = utility_value(expected) if wanted is None else wanted
    return (
        F.when(is_missing(extracted) | is_missing(expected), 0.0)
        .when(wanted == "0", _score(extracted.rlike("Utility:[1-5]")))
        .when(got == "0", 0.0)
        .otherwise(_closeness(got, wanted))
    )


def _same_token(extracted: Column, expected: Column) -> Column:
    missing = is_missing(extracted) | is_missing(expected)
    return F.when(missing, 0.0).otherwise(_score(strip(extracted) == strip(expected)))


def relevance_grade(extracted: Column, expected: Column) -> Column:
    """1.0 for the same token, case and all."""
    return _same_token(extracted, expected)


def groundness_grade(extracted: Column, expected: Column, normalize_slash: bool = False) -> Column:
    """1.0 for the same token; ``normalize_slash`` takes the data's and the prompt's spelling as one."""
    if normalize_slash:
        extracted, expected = (
            F.replace(c, F.lit(V.NO_SUPPORT), F.lit(V.NO_SUPPORT_PROMPT)) for c in (extracted, expected)
        )
    return _same_token(extracted, expected)


def content_score(relevance: Column, utility: Column, groundness: Column, correctness: Column) -> Column:
    """Mean of the three token grades and answer correctness; a missing verdict counts 0."""
    return (relevance + utility + groundness + F.coalesce(correctness, F.lit(0.0))) / F.lit(4.0)


def overall_score(structure: Column, content: Column) -> Column:
    """Mean of structure and content score."""
    return (structure + content) / F.lit(2.0)


def grade_structure(df: DataFrame, text_col: str = "generation") -> DataFrame:
    """Add the five structure scores and their mean."""
    tags = F.col("_tags")
    graded = df.withColumn("_tags", sorted_tags(F.coalesce(F.col(text_col), F.lit("")))).withColumns(
        {name: _score(_paired(tags, tag)) for name, tag in zip(V.STRUCTURE_METRICS, V.TAGS)}
    )
    mean = _mean_structure([F.col(name) for name in V.STRUCTURE_METRICS])
    return graded.withColumn("overall_structure_score", mean).drop("_tags")


# Where each extracted value stands in a generation.
EXTRACTED = {
    "extracted_answer": "answer",
    "extracted_relevance": "contextual-relevance",
    "extracted_utility": "answer-utility",
    "extracted_groundness": "groundness",
}


def extracted_tokens(df: DataFrame, text_col: str = "generation", names: Iterable[str] = EXTRACTED) -> DataFrame:
    """Add what the generation says: extracted answer, relevance, utility and groundness.

    Grades use an extracted value several times, so it gets a column of its own first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({name: tag_content(text, EXTRACTED[name]) for name in names})


def utility_values(df: DataFrame) -> DataFrame:
    """Add the numbers of the extracted and the expected utility as ``_got`` and ``_wanted``."""
    return df.withColumns({"_got": utility_value(F.col("extracted_utility")), "_wanted": utility_value(F.col("utility"))})


def grade_tokens(df: DataFrame, normalize_slash: bool = False) -> DataFrame:
    """Add the three token grades, from the extracted tokens and the label columns."""
    got = {name: F.col(f"extracted_{name}") for name in ("relevance", "utility", "groundness")}
    graded = utility_values(df).withColumns(
        {
            "relevance_correct": relevance_grade(got["relevance"], F.col("relevance")),
            "utility_correct": utility_grade(got["utility"], F.col("utility"), F.col("_got"), F.col("_wanted")),
            "groundness_correct": groundness_grade(got["groundness"], F.col("groundness"), normalize_slash),
        }
    )
    return graded.drop("_got", "_wanted")


def grade_generations(
    df: DataFrame, verdicts: DataFrame, normalize_slash: bool = False, verdict_order: str | None = None
) -> DataFrame:
    """All 14 metrics per generation; missing verdicts stay NULL and count 0 in the scores.

    ``verdict_order`` tells which of several verdicts counts, see :func:`judge.wide_verdicts`.
    """
    graded = grade_tokens(extracted_tokens(grade_structure(df)), normalize_slash)
    graded = attach_judge(graded, verdicts, order=verdict_order)
    content = content_score(*[F.col(c) for c in V.CONTENT_METRICS])
    graded = graded.withColumn("content_score", content)
    return graded.withColumn("overall_score", overall_score(F.col("overall_structure_score"), F.col("content_score")))
