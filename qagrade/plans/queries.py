"""One query per operator, over whole tables derived from the given ones."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import occurrences, tag_content, tags_found
from qagrade.operators import grade, judge, parse, prompts, rewards, splits, summary
from qagrade.operators.batched import batched_apply
from qagrade.operators.index import row_index
from qagrade.plans import fixtures
from qagrade.plans.harness import ensure_folder
from qagrade.sources import io
from qagrade.sources.scratch import pin, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = judge.GENERATION_KEY


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_folder(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


# --- inputs shared by the queries ---------------------------------------------------------


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixtures.tagged(spark, sf_dir)
    return df.filter(parse.retrieval_gate(F.col("output")))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.process_dataset(fixtures.tagged(spark, sf_dir), remove_output=True)


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed table, written and read back.

    Filters on it are plain column filters. On the unwritten table Spark would push them
    below the projection and parse every text once more for them.
    """
    return pin(_parsed(spark, sf_dir), "parsed")


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.quality_filter(_published(spark, sf_dir))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainders = _gated(spark, sf_dir).withColumn("remainder", parse.parse_remainder(F.col("output")))
    coded = remainders.withColumn("relevance", parse.extract_relevance(F.col("remainder")))
    return coded.withColumn("body", parse.answer_body(F.col("remainder"), F.col("relevance")))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.extracted_tokens(fixtures.generations(spark, sf_dir))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.grade_generations(fixtures.generations(spark, sf_dir), fixtures.verdicts(spark, sf_dir))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.attach_judge(fixtures.generations(spark, sf_dir), fixtures.verdicts(spark, sf_dir))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.generations(spark, sf_dir)
    for reward in (rewards.reward_structure, rewards.reward_relevance, rewards.reward_groundness, rewards.reward_utility):
        rows = reward(rows)
    rows = rows.select(*KEY, *[c for c in rows.columns if c in rewards.REWARDS])
    rows = rewards.reward_correctness(judge.attach_judge(rows, fixtures.verdicts(spark, sf_dir)))
    return rewards.reward_total(rows).select(*KEY, *rewards.REWARDS, "reward_total")


def _summary(spark: SparkSession, sf_dir: str, by: str | None) -> DataFrame:
    scores = summary.score_summary(_graded(spark, sf_dir), by)
    means = {f"{m}_mean": F.round(f"{m}_mean", 6) for m in V.METRICS}
    return scores.withColumns(means | {"groundness_correct_labelled": F.round("groundness_correct_labelled", 6)})


# --- sources and sinks --------------------------------------------------------------------


@query
def scan_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.read_table(spark, f"{sf_dir}/documents.parquet")


@query
def scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    io.write_splits(splits.assemble_splits(_eligible(spark, sf_dir), "row_id"), path)
    return io.read_table(spark, path, split="validation").select("row_id", "context", "relevance", "answer", "split")


@query
def sink_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parsed")
    io.write_table(_parsed(spark, sf_dir), path)
    return io.read_table(spark, path).select("row_id", *V.PARSED_COLUMNS)


@query
def sink_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    io.write_splits(splits.assemble_splits(_eligible(spark, sf_dir), "row_id"), path)
    return io.read_table(spark, path).select("row_id", *V.PARSED_COLUMNS, "split")


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    parsed = _published(spark, sf_dir)
    rows = parsed.join(row_index(parsed.select("row_id"), ["row_id"]), "row_id")
    io.write_jsonl(prompts.add_prompts(rows), path)
    schema = (
        "index BIGINT, row_id BIGINT, instruction STRING, context STRING, relevance STRING, answer STRING, "
        "groundness STRING, utility STRING, formatted_text STRING, expected_answer STRING, "
        "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
    )
    back = io.read_jsonl(spark, path, schema)
    return back.select(
        "index",
        "row_id",
        *V.PARSED_COLUMNS,
        "expected_answer",
        "formatted_text",
        F.col("messages")[1]["role"].alias("last_role"),
        F.col("messages")[1]["content"].alias("last_content"),
    )


@query
def sink_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scores")
    io.write_scores(summary.score_summary(_graded(spark, sf_dir), "model"), path)
    return io.read_jsonl(spark, path, io.score_schema())


# --- parsing ------------------------------------------------------------------------------


@query
def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("row_id", "output")


@query
def extract_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("row_id", parse.extract_context(F.col("output")).alias("context"))


@query
def parse_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("row_id", parse.parse_remainder(F.col("output")).alias("remainder"))


@query
def extract_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("row_id", "relevance", "body")


@query
def first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bodies(spark, sf_dir).withColumn("first", parse.first_token(F.col("body")))
    return found.select("row_id", F.col("first.token").alias("token"), F.col("first.position").alias("position"))


@query
def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("row_id", parse.extract_answer(F.col("body")).alias("answer"))


@query
def extract_groundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    groundness = parse.extract_groundness(F.col("body"), F.col("relevance"))
    return _bodies(spark, sf_dir).select("row_id", groundness.alias("groundness"))


@query
def extract_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    utility = parse.extract_utility(F.col("body"), F.col("relevance"))
    return _bodies(spark, sf_dir).select("row_id", utility.alias("utility"))


@query
def parse_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_tagged(fixtures.tagged(spark, sf_dir))


@query
def process_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir)


@query
def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.filter_audit(fixtures.tagged(spark, sf_dir))


@query
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.label_distribution(_parsed(spark, sf_dir))


# --- filters, codes and splits ------------------------------------------------------------


@query
def filter_has_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).filter(splits.has_context()).select("row_id", "context")


@query
def filter_min_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).filter(splits.has_min_context()).select("row_id", "context")


@query
def filter_has_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).filter(splits.has_relevance()).select("row_id", "relevance")


@query
def filter_has_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _published(spark, sf_dir).filter(splits.has_answer()).select("row_id", "answer")


@query
def class_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = splits.class_encode(_eligible(spark, sf_dir), "relevance", "relevance_class_label")
    return coded.select("row_id", "relevance", "relevance_class_label")


@query
def stratum_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _eligible(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))
    return splits.stratum_quota(counts, V.TRAIN_ROWS, "source")


_SIZES = {"train": V.TRAIN_ROWS, "heldout": V.HELDOUT_ROWS}
_HALVES = {"test": V.HELDOUT_ROWS // 2, "validation": V.HELDOUT_ROWS // 2}


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = splits.stratified_split(_eligible(spark, sf_dir), "row_id", "relevance", _SIZES)
    return drawn.select("row_id", "relevance", "split")


@query
def split_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = splits.stratified_split(_eligible(spark, sf_dir), "row_id", "relevance", _SIZES)
    halved = splits.split_holdout(drawn, "row_id", "relevance", _HALVES)
    return halved.filter(F.col("split") != "train").select("row_id", "relevance", "split")


@query
def assemble_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assemble_splits(_eligible(spark, sf_dir), "row_id")


@query
def split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_balance(splits.assemble_splits(_eligible(spark, sf_dir), "row_id"))


@query
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Copies in `documents` cross splits; their instruction names the document, so the context is compared.
    texts = _eligible(spark, sf_dir).withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "test", "validation"))), (F.col("row_id") % 3 + 1).cast("int")))
    return splits.split_overlap(texts, ["context"])


@query
def split_overlap_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Three quarters of the rows are drawn, so that copies cross.
    eligible = _eligible(spark, sf_dir)
    n = eligible.count()
    return splits.split_overlap(splits.assemble_splits(eligible, "row_id", train=n // 2, heldout=n // 4), ["context"])


# --- prompts and result rows --------------------------------------------------------------


@query
def user_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    question, context = F.col("instruction"), F.col("context")
    text = prompts.render_template(prompts.USER_TEMPLATE, question=question, context=context)
    missing = prompts.missing_inputs(question, context)
    return _parsed(spark, sf_dir).select("row_id", text.alias("user_prompt"), missing.alias("missing_inputs"))


@query
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = prompts.add_prompts(_parsed(spark, sf_dir)).select("row_id", F.posexplode("messages"))
    return messages.select(
        "row_id", F.col("pos").alias("position"), F.col("col.role").alias("role"), F.col("col.content").alias("content")
    )


@query
def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prompts.conversation_messages(io.read_table(spark, f"{sf_dir}/conversations.parquet"))
    messages = F.col("messages")
    return rows.select(
        "conv_id",
        "n_messages",
        F.element_at(messages, 1)["role"].alias("first_role"),
        F.element_at(messages, -1)["content"].alias("last_content"),
        prompts.render_chat(messages).alias("formatted_text"),
    )


@query
def row_index_(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _parsed(spark, sf_dir).select("source", "row_id")
    return row_index(keys, ["source", "row_id"]).select("index", "source", "row_id")


QUERIES["row_index"] = QUERIES.pop("row_index_")


@query
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.add_prompts(_parsed(spark, sf_dir)).select("row_id", "formatted_text")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    generations = fixtures.generations(spark, sf_dir).select(*KEY, "generation")
    return prompts.result_rows(_published(spark, sf_dir), generations)


@query
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(
        "index", *KEY, "instruction", *V.PARSED_COLUMNS, "formatted_text", "generation"
    )


@query
def result_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Generations of documents that parsing drops have no prompt; rows without a relevance get no key.
    asked = _published(spark, sf_dir).select(F.when(F.col("relevance").isNotNull(), F.col("row_id")).alias("row_id"))
    said = fixtures.generations(spark, sf_dir).filter("generation <> '' AND model = 'base' AND sample = 0").select("row_id")
    return prompts.result_account(asked, said)


@query
def sample_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    preview = prompts.sample_preview(_results(spark, sf_dir))
    return preview.select("index", "model", "sample", "instruction", "generation")


@query
def batched_apply_(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stands for outside code: a text per prompt. Local, so that it travels by value.
    def quoted_reply(batch: pd.DataFrame) -> pd.DataFrame:
        reply = "<answer>" + batch["formatted_text"] + "</answer>"
        return pd.DataFrame({"row_id": batch["row_id"], "generation": reply})

    asked = prompts.add_prompts(_parsed(spark, sf_dir)).select("row_id", "formatted_text")
    return batched_apply(asked, quoted_reply, "row_id bigint, generation string")


QUERIES["batched_apply"] = QUERIES.pop("batched_apply_")


# --- grading ------------------------------------------------------------------------------


@query
def tag_content_(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = [tag_content(F.col("generation"), tag).alias(V.column_name(tag)) for tag in V.TAGS]
    return fixtures.generations(spark, sf_dir).select(*KEY, *contents)


QUERIES["tag_content"] = QUERIES.pop("tag_content_")


@query
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fixtures.generations(spark, sf_dir).select(*KEY, tags_found(F.col("generation")).alias("found"))
    counts = [
        occurrences(F.col("found"), token.format(tag)).alias(f"{V.column_name(tag)}_{side}")
        for tag in V.TAGS
        for side, token in (("open", "<{}>"), ("close", "</{}>"))
    ]
    return found.select(*KEY, *counts)


@query
def tag_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.grade_structure(fixtures.generations(spark, sf_dir)).select(*KEY, *V.STRUCTURE_METRICS)


@query
def structure_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = grade.structure_score(F.col("generation")).alias("overall_structure_score")
    return fixtures.generations(spark, sf_dir).select(*KEY, score)


@query
def utility_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).select(
        *KEY,
        grade.utility_value(F.col("extracted_utility")).alias("extracted_value"),
        grade.utility_value(F.col("utility")).alias("expected_value"),
    )


@query
def utility_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = grade.utility_grade(F.col("extracted_utility"), F.col("utility"))
    return _extracted(spark, sf_dir).select(*KEY, score.alias("utility_correct"))


@query
def utility_grade_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = grade.utility_grade_reward(F.col("extracted_utility"), F.col("utility"))
    return _extracted(spark, sf_dir).select(*KEY, score.alias("utility_correct"))


@query
def relevance_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = grade.relevance_grade(F.col("extracted_relevance"), F.col("relevance"))
    return _extracted(spark, sf_dir).select(*KEY, score.alias("relevance_correct"))


@query
def groundness_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = (F.col("extracted_groundness"), F.col("groundness"))
    return _extracted(spark, sf_dir).select(
        *KEY,
        grade.groundness_grade(*tokens).alias("groundness_correct"),
        grade.groundness_grade(*tokens, normalize_slash=True).alias("groundness_correct_normalized"),
    )


@query
def structure_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = grade.structure_order(F.col("generation"))
    return fixtures.generations(spark, sf_dir).select(*KEY, score.alias("structure_order"))


@query
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(*KEY, F.round("content_score", 6).alias("content_score"))


@query
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(*KEY, F.round("overall_score", 6).alias("overall_score"))


@query
def grade_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir).select(*KEY, *[F.round(m, 6).alias(m) for m in V.METRICS])


# --- judge verdicts -----------------------------------------------------------------------


@query
def judge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select(*KEY, *V.VERDICTS, "judged")


@query
def judge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fixtures.verdict_log(spark, sf_dir)
    judged = judge.attach_judge(fixtures.generations(spark, sf_dir), log, order="seq")
    return judged.select(*KEY, *V.VERDICTS, "judged", "judge_conflicts")


@query
def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = judge.judge_requests(fixtures.generations(spark, sf_dir), on_missing="answer")
    return judge.distinct_requests(requests)


@query
def judge_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge.judge_pass(_judged(spark, sf_dir)).select(*KEY, "faithfulness_pass", "answer_relevancy_pass")


@query
def batched_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stands for outside code: a number from the lengths of the texts. It judges nothing.
    def length_share(batch: pd.DataFrame) -> pd.DataFrame:
        answer, question = batch["answer"].str.len(), batch["question"].str.len()
        return batch[["request_id", "metric"]].assign(score=answer / (answer + question))

    requests = judge.judge_requests(fixtures.generations(spark, sf_dir))
    # The relevancy requests count as answered already.
    answered = requests.filter(F.col("metric") == "answer_relevancy").select("request_id")
    answers = judge.batched_judge(requests, answered, length_share)
    return judge.verdicts_of(requests, answers).withColumn("score", F.round("score", 6))


# --- rewards ------------------------------------------------------------------------------


@query
def completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rewards.completion_text(
        fixtures.completions(spark, sf_dir), labels=("relevance", "utility", "groundness")
    )
    return rows.select(*KEY, "generation", "relevance", "utility", "groundness")


@query
def reward_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.reward_correctness(_judged(spark, sf_dir)).select(*KEY, "reward_correctness")


@query
def reward_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.reward_structure(fixtures.generations(spark, sf_dir)).select(*KEY, "reward_structure")


@query
def reward_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.reward_relevance(fixtures.generations(spark, sf_dir)).select(*KEY, "reward_relevance")


@query
def reward_groundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.reward_groundness(fixtures.generations(spark, sf_dir)).select(*KEY, "reward_groundness")


@query
def reward_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewards.reward_utility(fixtures.generations(spark, sf_dir)).select(*KEY, "reward_utility")


@query
def reward_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"faithfulness": 30.0, "relevancy": 20.0, "order": 5.0}
    table = rewards.reward_table(fixtures.completions(spark, sf_dir), fixtures.verdict_log(spark, sf_dir), weights=weights, verdict_order="seq")
    return table.select(*KEY, "reward_faithfulness", "reward_relevancy", "reward_order", "reward_total")


@query
def reward_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir).select(*KEY, "reward_total")


@query
def group_advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = rewards.group_advantage(pin(_totals(spark, sf_dir), "totals"))
    return scored.select(*KEY, F.round("advantage", 6).alias("advantage"))


@query
def reward_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rewards.reward_table(fixtures.completions(spark, sf_dir), fixtures.verdicts(spark, sf_dir))
    return table.withColumn("advantage", F.round("advantage", 6))


# --- summaries ----------------------------------------------------------------------------


@query
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, None)


@query
def score_summary_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(spark, sf_dir, "model")


@query
def model_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = summary.model_compare(_graded(spark, sf_dir), "base", "tuned")
    return sides.select("metric", *[F.round(c, 6).alias(c) for c in ("base", "other", "difference")])


@query
def score_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.score_long(_graded(spark, sf_dir)).withColumn("mean", F.round("mean", 6))
