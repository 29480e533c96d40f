from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F

from qagrade.operators import rewards

KEY = "row_id long, model string, sample int"
GOOD = (
    "<think>t</think><answer>a</answer><contextual-relevance>[Relevant]</contextual-relevance>"
    "<answer-utility>[Utility:4]</answer-utility><groundness>[Fully supported]</groundness>"
)


def completions(spark):
    rows = [
        (
            1, "m",
            [[("assistant", GOOD), ("user", "later")], [("assistant", "nothing")], [("assistant", None)]],
            ["[Relevant]", "[Relevant]", None],
            ["[Utility:5]", None, "odd"],
            [None, "[Fully supported]", None],
        )
    ]
    return spark.createDataFrame(
        rows,
        "row_id long, model string, completions array<array<struct<role:string,content:string>>>,"
        " relevance array<string>, utility array<string>, groundness array<string>",
    )


def test_completion_text(spark):
    rows = rewards.completion_text(completions(spark), labels=("relevance", "utility")).orderBy("sample").collect()
    assert [(r.sample, r.generation, r.relevance, r.utility) for r in rows] == [
        (0, GOOD, "[Relevant]", "[Utility:5]"), (1, "nothing", "[Relevant]", None), (2, None, None, "odd"),
    ]
    assert rows[0].groundness == [None, "[Fully supported]", None]


def test_completion_text_without_labels(spark):
    rows = rewards.completion_text(completions(spark)).orderBy("sample").collect()
    assert [r.generation for r in rows] == [GOOD, "nothing", None]
    assert rows[1].relevance == ["[Relevant]", "[Relevant]", None]


def test_reward_table(spark):
    verdicts = spark.createDataFrame([(1, "m", 0, "answer_correctness", 0.5)], f"{KEY}, metric string, score double")
    rows = rewards.reward_table(completions(spark), verdicts).orderBy("sample").collect()
    assert [r.reward_correctness for r in rows] == [10.0, 0.0, 0.0]
    assert [r.reward_structure for r in rows] == [10.0, 0.0, 0.0]
    assert [r.reward_relevance for r in rows] == [50.0, 0.0, 0.0]
    assert [r.reward_groundness for r in rows] == [0.0, 0.0, 0.0]
    assert [r.reward_utility for r in rows] == [75.0, 0.0, 0.0]
    assert [r.reward_total for r in rows] == [145.0, 0.0, 0.0]
    deviation = statistics.pstdev([145.0, 0.0, 0.0])
    assert rows[0].advantage == pytest.approx((145 - 145 / 3) / deviation)


def test_weights(spark):
    df = spark.range(1).select(*[F.lit(float(i)).alias(name) for i, name in enumerate(rewards.REWARDS, 1)])
    assert rewards.reward_total(df).first().reward_total == 15.0
    assert rewards.reward_total(df, {"utility": 0.0, "structure": 10.0}).first().reward_total == 1 + 20 + 3 + 4


def test_advantage_with_one_hot_group(spark):
    # group 0 holds most rows
    df = spark.range(900).select(
        F.when(F.col("id") < 600, F.lit(0)).otherwise(F.col("id") % 80).cast("long").alias("row_id"),
        F.lit("m").alias("model"),
        F.col("id").cast("int").alias("sample"),
        (F.col("id") * 37 % 11).cast("double").alias("reward_total"),
    )
    rows = rewards.group_advantage(df).collect()
    assert len(rows) == 900
    groups = {}
    for r in rows:
        groups.setdefault(r.row_id, []).append(r)
    for members in groups.values():
        values = [m.reward_total for m in members]
        mean, deviation = statistics.fmean(values), statistics.pstdev(values)
        for m in members:
            assert m.advantage == pytest.approx((m.reward_total - mean) / deviation if deviation else 0.0)


def test_equal_rewards_and_single_rows_have_no_advantage(spark):
    rows = [(1, "m", 0, 5.0), (1, "m", 1, 5.0), (2, "m", 0, 7.0)]
    df = spark.createDataFrame(rows, f"{KEY}, reward_total double")
    assert {r.advantage for r in rewards.group_advantage(df).collect()} == {0.0}


def test_null_keys_are_groups(spark):
    rows = [(1, None, 0, 1.0), (1, None, 1, 3.0), (None, None, 0, 5.0), (1, "m", 0, 9.0)]
    df = spark.createDataFrame(rows, f"{KEY}, reward_total double")
    got = {(r.row_id, r.model, r.sample): r.advantage for r in rewards.group_advantage(df).collect()}
    assert got == {(1, None, 0): -1.0, (1, None, 1): 1.0, (None, None, 0): 0.0, (1, "m", 0): 0.0}


def test_order_reward_counts_by_weight_only(spark):
    df = spark.range(1).select(*[F.lit(1.0).alias(name) for name in rewards.REWARDS], F.lit(1.0).alias("reward_order"))
    assert rewards.reward_total(df).first().reward_total == 5.0
    assert rewards.reward_total(df, {"order": 7.0}).first().reward_total == 12.0


def test_verdict_rewards_count_by_weight_only(spark):
    texts = spark.createDataFrame([(1, "m", [[("assistant", "x")]], ["r"], ["u"], ["g"])],
                                  "row_id long, model string, completions array<array<struct<role: string, content: string>>>, "
                                  "relevance array<string>, utility array<string>, groundness array<string>")  # fmt: skip
    verdicts = spark.createDataFrame(
        [(1, "m", 0, "faithfulness", 0.5, 1), (1, "m", 0, "faithfulness", 1.0, 2), (1, "m", 0, "answer_correctness", 0.25, 1)],
        f"{KEY}, metric string, score double, seq int",
    )
    plain = rewards.reward_table(texts, verdicts).first()
    assert plain.reward_total == 5.0 and not hasattr(plain, "reward_faithfulness")
    row = rewards.reward_table(texts, verdicts, weights={"faithfulness": 30.0, "relevancy": 9.0}, verdict_order="seq").first()
    assert (row.reward_faithfulness, row.reward_relevancy, row.reward_total) == (1.0, 0.0, 35.0)
