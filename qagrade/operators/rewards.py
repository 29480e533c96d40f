"""Reward tables for groups of completions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators.grade import (
    extracted_tokens,
    grade_structure,
    groundness_grade,
    relevance_grade,
    structure_order,
    utility_grade_reward,
    utility_values,
)
from qagrade.operators.judge import GENERATION_KEY, attach_judge
from qagrade.sources.scratch import pin, scoped

REWARDS = tuple(f"reward_{name}" for name in V.REWARD_SCALES)


def completion_text(df: DataFrame, col: str = "completions", labels: Sequence[str] = ()) -> DataFrame:
    """One row per completion: ``sample`` and the text of its first message as ``generation``.

    ``labels`` names columns that hold one label per completion, as arrays in the same
    order; they become plain columns. Other columns are repeated.
    """
    texts = F.transform(F.col(col), lambda completion: F.get(completion, F.lit(0))["content"])
    rows = df.withColumn(col, texts).select(
        *[c for c in df.columns if c not in (col, *labels)],
        F.posexplode(F.arrays_zip(col, *labels)).alias("sample", "_item"),
    )
    named = [F.col("_item")[col].alias("generation"), *[F.col("_item")[c].alias(c) for c in labels]]
    return rows.select(*[c for c in rows.columns if c != "_item"], *named)


def _scaled(name: str, grade: Column) -> Column:
    return grade * F.lit(V.REWARD_SCALES[name])


def _token_reward(df: DataFrame, name: str, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add a reward that compares one extracted token; ``add`` finds the token in its column."""
    token = f"extracted_{name}"
    rewarded = add(extracted_tokens(df, names=[token]))
    return rewarded if token in df.columns else rewarded.drop(token)


def reward_correctness(df: DataFrame) -> DataFrame:
    """20 x the verdict on correctness; a missing verdict counts 0."""
    return df.withColumn("reward_correctness", _scaled("correctness", F.coalesce("answer_correctness", F.lit(0.0))))


def reward_structure(df: DataFrame) -> DataFrame:
    """10 x the mean structure score."""
    rewarded = grade_structure(df).withColumn("reward_structure", _scaled("structure", F.col("overall_structure_score")))
    return rewarded.select(*df.columns, "reward_structure")


def reward_relevance(df: DataFrame) -> DataFrame:
    """50 x the relevance grade."""
    grade = relevance_grade(F.col("extracted_relevance"), F.col("relevance"))
    return _token_reward(df, "relevance", lambda rows: rows.withColumn("reward_relevance", _scaled("relevance", grade)))


def reward_groundness(df: DataFrame, normalize_slash: bool = False) -> DataFrame:
    """50 x the groundness grade."""
    grade = groundness_grade(F.col("extracted_groundness"), F.col("groundness"), normalize_slash)
    return _token_reward(df, "groundness", lambda rows: rows.withColumn("reward_groundness", _scaled("groundness", grade)))


def reward_utility(df: DataFrame) -> DataFrame:
    """100 x the utility grade, in its reward form."""
    grade = utility_grade_reward(F.col("extracted_utility"), F.col("utility"), F.col("_got"), F.col("_wanted"))

    def add(rows: DataFrame) -> DataFrame:
        return utility_values(rows).withColumn("reward_utility", _scaled("utility", grade)).drop("_got", "_wanted")

    return _token_reward(df, "utility", add)


def reward_order(df: DataFrame) -> DataFrame:
    """The order grade as a reward, 0.0 or 1.0; it counts only where a weight names it."""
    return df.withColumn("reward_order", structure_order(F.coalesce("generation", F.lit(""))))


def reward_faithfulness(df: DataFrame) -> DataFrame:
    """The verdict on faithfulness, a missing one as 0; it counts only where a weight names it."""
    return df.withColumn("reward_faithfulness", F.coalesce("faithfulness", F.lit(0.0)))


def reward_relevancy(df: DataFrame) -> DataFrame:
    """The verdict on the answer's relevancy, a missing one as 0; it counts only where a weight names it."""
    return df.withColumn("reward_relevancy", F.coalesce("answer_relevancy", F.lit(0.0)))


#: Rewards that are off without a weight: by the text, and by the verdicts.
_OF_TEXT = {"order": reward_order}
_OF_VERDICTS = {"faithfulness": reward_faithfulness, "relevancy": reward_relevancy}


def reward_total(df: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Sum of the five rewards, or their weighted sum (weights by name, 1.0 where absent).

    A weight for ``order``, ``faithfulness`` or ``relevancy`` adds that reward, which is off otherwise.
    """
    weights = weights or {}
    names = [*V.REWARD_SCALES, *[n for n in (*_OF_TEXT, *_OF_VERDICTS) if n in weights]]
    parts = [F.col(f"reward_{name}") * F.lit(float(weights.get(name, 1.0))) for name in names]
    return df.withColumn("reward_total", sum(parts[1:], parts[0]))


@scoped
def group_advantage(
    df: DataFrame, group: Sequence[str] = ("row_id", "model"), reward: str = "reward_total"
) -> DataFrame:
    """Add ``advantage``: the reward's distance from its group's mean in standard deviations.

    The deviation is that of the population; a group whose rewards are all equal gets 0, and
    a NULL in the group's key is a value like others. Group statistics are combined before
    their shuffle and stored, and come back by one plain join, which Spark broadcasts when
    they are small and splits where a group is hot. ``df`` is read for both, so it should be
    a table.
    """
    stats = df.groupBy(*[F.col(c).alias(f"_{c}") for c in group]).agg(
        F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_deviation")
    )
    stats = pin(stats, "group-stats")
    same = [df[c].eqNullSafe(stats[f"_{c}"]) for c in group]
    distance = (F.col(reward) - F.col("_mean")) / F.col("_deviation")
    advantage = F.when(F.col("_deviation") > 0, distance).otherwise(0.0)
    return df.join(stats, same).select(*[df[c] for c in df.columns], advantage.alias("advantage"))


@scoped
def reward_table(
    df: DataFrame,
    verdicts: DataFrame,
    labels: Sequence[str] = ("relevance", "utility", "groundness"),
    weights: Mapping[str, float] | None = None,
    verdict_order: str | None = None,
) -> DataFrame:
    """One row per completion: key, the five rewards, their total and the group's advantage.

    Rewards are computed where the text is; only keys and numbers are shuffled. They are
    written as an intermediate table, because the advantage reads them twice and reading
    the texts again would cost more.
    """
    weights = weights or {}
    by_text = [fn for name, fn in _OF_TEXT.items() if name in weights]
    by_verdict = [fn for name, fn in _OF_VERDICTS.items() if name in weights]
    names = [*REWARDS, *[f"reward_{name}" for name in (*_OF_TEXT, *_OF_VERDICTS) if name in weights]]
    rows = completion_text(df, labels=labels)
    for reward in (reward_structure, reward_relevance, reward_groundness, reward_utility, *by_text):
        rows = reward(rows)
    rows = rows.select(*GENERATION_KEY, *[c for c in rows.columns if c in names])
    rows = attach_judge(rows, verdicts, order=verdict_order)
    for reward in (reward_correctness, *by_verdict):
        rows = reward(rows)
    rows = reward_total(rows, weights)
    return group_advantage(pin(rows.select(*GENERATION_KEY, *names, "reward_total"), "rewards"))
