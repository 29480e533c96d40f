"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest

from qagrade.operators import grade, parse, prompts, rewards, splits, summary
from qagrade.operators.index import row_index
from qagrade.plans import fixtures
from qagrade.plans.queries import QUERIES
from qagrade.sources.scratch import pin


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {
        "tagged": pin(fixtures.tagged(spark, sf_dir), "tagged"),
        "generations": pin(fixtures.generations(spark, sf_dir), "generations"),
        "completions": pin(fixtures.completions(spark, sf_dir), "completions"),
        "verdicts": pin(fixtures.verdicts(spark, sf_dir), "verdicts"),
    }


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas")


def test_parsing_and_grading_need_no_shuffle_and_no_python(tables):
    parsed = physical(parse.process_dataset(tables["tagged"]))
    graded = physical(grade.grade_tokens(grade.extracted_tokens(grade.grade_structure(tables["generations"]))))
    for plan in (parsed, graded):
        assert "Exchange" not in plan
        assert not any(word in plan for word in PYTHON)
        # one generated stage from the scan to the last projection
        assert set(re.findall(r"\*\((\d+)\)", plan)) == {"1"}


def test_only_the_texts_that_are_graded_are_read(tables):
    plan = physical(summary.score_summary(grade.grade_generations(tables["generations"], tables["verdicts"]), "model"))
    (columns,) = {c for c in re.findall(r"FileScan parquet \[([^\]]*)\]", plan) if "generation" in c}
    assert {c.split("#")[0] for c in columns.split(",")} == {
        "row_id", "model", "sample", "relevance", "utility", "groundness", "generation",
    }
    assert not any(word in plan for word in PYTHON)


def test_texts_are_not_shuffled_for_verdicts(tables):
    graded = grade.grade_generations(tables["generations"], tables["verdicts"])
    plan = graded.select("row_id", "model", "sample", "overall_score")._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter") :].splitlines()[1]
    assert "overall_structure_score" in left and "generation#" not in left.split("AS")[0]


def test_each_cut_of_a_text_is_made_once(tables):
    plan = physical(parse.process_dataset(tables["tagged"], remove_output=True))
    assert plan.count("split(") == 3
    assert plan.count("<paragraph>, 2") == 1


def test_no_window_over_data_rows_is_unpartitioned(tables):
    parsed = pin(parse.process_dataset(tables["tagged"]), "parsed")
    eligible = splits.quality_filter(parsed)
    # rows are numbered where they are read
    indexed = physical(row_index(parsed, ["row_id"]))
    assert "Window" not in indexed and "Exchange" not in indexed
    drawn = physical(splits.assemble_splits(eligible, "row_id", train=40, heldout=10))
    assert "Window" not in drawn and "hashpartitioning" not in drawn
    assert drawn.count("BroadcastHashJoin") == 1


def test_filters_reach_the_scan(tables):
    eligible = splits.quality_filter(pin(parse.process_dataset(tables["tagged"]), "parsed"))
    (pushed,) = re.findall(r"PushedFilters: \[([^\]]*)\]", physical(eligible))
    assert {"IsNotNull(context)", "IsNotNull(relevance)", "IsNotNull(answer)"} <= set(pushed.split(", "))


def test_rewards_carry_no_texts(tables):
    table = rewards.reward_table(tables["completions"], tables["verdicts"])
    plan = physical(table)
    assert "completions" not in plan and not any(word in plan for word in PYTHON)


def test_generations_are_joined_by_plain_shuffles(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parsed = pin(parse.process_dataset(tables["tagged"]), "parsed")
        plan = physical(prompts.result_rows(parsed, tables["generations"].select("row_id", "model", "sample", "generation")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # run-time skew handling wants sort over exchange on both sides of the inner join
    lines = plan.splitlines()
    assert sum("SortMergeJoin" in line and "Inner" in line for line in lines) == 3
    assert not any("_bucket" in line or "formatted_text" in line for line in lines if "Exchange" in line)


def test_row_stages_stay_small_enough_to_be_compiled(spark, tables):
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    rows = rewards.completion_text(tables["completions"], labels=("relevance", "utility", "groundness"))
    for reward in (rewards.reward_structure, rewards.reward_relevance, rewards.reward_groundness, rewards.reward_utility):
        rows = reward(rows)
    graded = grade.grade_tokens(grade.extracted_tokens(grade.grade_structure(tables["generations"])))
    for df in (parse.process_dataset(tables["tagged"]), graded, rows.drop("generation")):
        stages = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
        assert stages.size() > 0
        # the JVM leaves methods above 8000 bytes to the interpreter
        assert all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_result_rows_number_keys_and_read_generations_once(spark, tables):
    parsed = pin(parse.process_dataset(tables["tagged"]), "parsed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = pin(tables["generations"].select("row_id", "model", "sample", "generation"), "answers")
        plan = physical(prompts.result_rows(parsed, answers))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" not in plan and plan.count("generation:string") == 1


def test_nothing_uses_python_where_expressions_do(spark, sf_dir):
    for name in ("tag_counts", "structure_order", "reward_utility", "judge_requests", "completion_text", "render_chat"):
        assert not any(word in physical(QUERIES[name](spark, sf_dir)) for word in PYTHON), name
