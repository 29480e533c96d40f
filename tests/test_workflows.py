from __future__ import annotations

import json
import os
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from qagrade.plans import fixtures, workflows
from qagrade.sources import io


def test_from_annotated_outputs_to_scores(spark, sf_dir, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    run_all(spark, sf_dir, tmp_path)
    assert set(os.listdir(folder)) == before


def run_all(spark, sf_dir, tmp_path):
    path = {name: str(tmp_path / name) for name in ("tagged", "parsed", "splits", "results", "graded", "scores", "rewards")}
    io.write_table(fixtures.tagged(spark, sf_dir), path["tagged"])
    workflows.prepare_splits(spark, path["tagged"], path["parsed"], path["splits"], train=60, heldout=20)
    assert {r["split"]: r["count"] for r in spark.read.parquet(path["splits"]).groupBy("split").count().collect()} == {
        "train": 60, "test": 10, "validation": 10,
    }

    called = spark.sparkContext.accumulator(0)

    def generate(batch: pd.DataFrame, model: str) -> pd.DataFrame:
        called.add(len(batch))
        return batch[["row_id"]].assign(generation=f"<answer>{model}</answer>")

    workflows.generate_answers(spark, path["splits"], path["results"], generate, setup=lambda: "m")
    assert called.value == 10  # once a prompt
    schema = "row_id long, index long, relevance string, utility string, groundness string, generation string"
    results = workflows.named_results(spark, path["results"], "m", schema)
    assert sorted(r["index"] for r in results.collect()) == list(range(10))

    workflows.grade_results(results, fixtures.verdicts(spark, sf_dir), path["graded"], path["scores"])
    (line,) = [x for p in Path(path["scores"]).glob("part-*") for x in p.read_text().splitlines()]
    scores = json.loads(line)
    assert (scores["model"], scores["n"], scores["answer_structure"], scores["overall_structure_score"]) == ("m", 10, 1.0, 0.2)

    asked = spark.sparkContext.accumulator(0)

    def lengths(batch: pd.DataFrame) -> pd.DataFrame:
        asked.add(len(batch))
        return batch[["request_id", "metric"]].assign(score=1.0)

    for run in ("one", "two"):
        workflows.judge_and_grade(
            results.withColumns({"instruction": results.relevance, "context": results.relevance, "answer": results.relevance}),
            str(tmp_path / "answers"), lengths, str(tmp_path / f"graded-{run}"), str(tmp_path / f"scores-{run}"),
        )
    assert asked.value == spark.read.parquet(str(tmp_path / "answers")).count() > 0
    completions = fixtures.completions(spark, sf_dir).withColumns(
        {c: F.col("row_id").cast("string") for c in ("instruction", "context", "answer")}
    )
    workflows.judge_and_reward(completions, str(tmp_path / "answers"), lengths, str(tmp_path / "judged-rewards"))
    assert spark.read.parquet(str(tmp_path / "judged-rewards")).where("reward_correctness = 20").count() == 8 * completions.count() / 2
    assert asked.value == spark.read.parquet(str(tmp_path / "answers")).count()

    workflows.reward_completions(fixtures.completions(spark, sf_dir), fixtures.verdicts(spark, sf_dir), path["rewards"])
    table = spark.read.parquet(path["rewards"])
    assert table.count() == 8 * spark.read.parquet(f"{sf_dir}/documents.parquet").count()
