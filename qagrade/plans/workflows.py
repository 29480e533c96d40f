"""The three ways through the library, from stored tables to stored tables.

Each deletes its intermediate tables when it ends.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from typing import Any, TypeVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators import batched, grade, judge, parse, prompts, rewards, splits, summary
from qagrade.sources import io
from qagrade.sources.scratch import pin, scope

_Fn = TypeVar("_Fn", bound=Callable[..., None])


def workflow(fn: _Fn) -> _Fn:
    @functools.wraps(fn)
    def run(*args, **kwargs) -> None:
        with scope():
            fn(*args, **kwargs)

    return run


@workflow
def prepare_splits(
    spark: SparkSession,
    annotated: str,
    parsed_out: str,
    splits_out: str,
    key: str = "row_id",
    train: int = V.TRAIN_ROWS,
    heldout: int = V.HELDOUT_ROWS,
    seed: int = 0,
) -> None:
    """Annotated outputs to a parsed table, and that to train, test and validation splits.

    The parsed table is written before it is filtered: the filters are then plain column
    filters, and the texts are parsed once.
    """
    io.write_table(parse.process_dataset(io.read_table(spark, annotated)), parsed_out)
    eligible = splits.quality_filter(io.read_table(spark, parsed_out))
    io.write_splits(splits.assemble_splits(eligible, key, train=train, heldout=heldout, seed=seed), splits_out)


@workflow
def generate_answers(
    spark: SparkSession,
    splits_in: str,
    results_out: str,
    generate: Callable[..., pd.DataFrame],
    setup: Callable[[], Any] | None = None,
    split: str = "validation",
    key: str = "row_id",
    batch_rows: int = 64,
) -> None:
    """Prompts of one split to JSON lines with a generation per prompt.

    ``generate`` gets frames with the key and ``formatted_text`` and returns the key and
    ``generation``; ``setup`` opens the model, once per partition.
    """
    rows = io.read_table(spark, splits_in, split=split)
    asked = prompts.add_prompts(rows).select(key, "formatted_text")
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, generation string"
    # stored before it is used: the result reads it twice, and a model must not be asked twice
    answers = batched.batched_store(asked, generate, schema, "generations", batch_rows, setup)
    io.write_jsonl(prompts.result_rows(rows, answers, key), results_out)


@workflow
def grade_results(results: DataFrame, verdicts: DataFrame, graded_out: str, scores_out: str) -> None:
    """Generations of one or more models to a table of grades and one score object per model."""
    graded = grade.grade_generations(results, verdicts)
    io.write_table(graded.select("row_id", "model", "sample", "groundness", "judged", *V.METRICS), graded_out)
    io.write_scores(summary.score_summary(io.read_table(results.sparkSession, graded_out), "model"), scores_out)


@workflow
def judge_and_grade(
    results: DataFrame, answers_table: str, fn: Callable[..., pd.DataFrame], graded_out: str, scores_out: str, **options: Any
) -> None:
    """Results to requests, answers that are still pending, verdicts, grades and scores.

    ``answers_table`` keeps all answers; a second run asks nothing.
    """
    requests = pin(judge.judge_requests(results, **options), "requests")
    verdicts = judge.verdicts_of(requests, judge.ask_pending(requests, answers_table, fn))
    grade_results(results, pin(verdicts, "verdicts"), graded_out, scores_out)


@workflow
def judge_and_reward(
    completions: DataFrame,
    answers_table: str,
    fn: Callable[..., pd.DataFrame],
    out: str,
    labels: Sequence[str] = ("relevance", "utility", "groundness"),
) -> None:
    """Completions to correctness requests on the whole reply, answers, verdicts and rewards."""
    rows = rewards.completion_text(completions, labels=labels)
    requests = judge.judge_requests(rows, on_missing="answer", whole_response=True, metrics=["answer_correctness"])
    requests = pin(requests, "requests")
    verdicts = judge.verdicts_of(requests, judge.ask_pending(requests, answers_table, fn))
    io.write_table(rewards.reward_table(completions, pin(verdicts, "verdicts"), labels), out)


@workflow
def reward_completions(completions: DataFrame, verdicts: DataFrame, out: str) -> None:
    """Groups of completions to a reward table with advantages, for a trainer to read."""
    io.write_table(rewards.reward_table(completions, verdicts), out)


def named_results(spark: SparkSession, path: str, model: str, schema: str) -> DataFrame:
    """A model's result file as generations: first sample of each prompt."""
    rows = io.read_jsonl(spark, path, schema)
    return rows.withColumns({"model": F.lit(model), "sample": F.lit(0)})
