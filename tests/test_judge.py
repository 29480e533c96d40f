from __future__ import annotations

import os
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from qagrade.operators import judge
from qagrade.operators.answers import AnswerLog

KEY = "row_id long, model string, sample int"


@pytest.fixture(scope="module")
def generations(spark):
    rows = [
        (1, "a", 0, "q1", "c1", "truth1", "<answer>x</answer>"),
        (1, "a", 1, "q1", "c1", "truth1", "<answer>x</answer>"),
        (1, "b", 0, "q1", "c1", "truth1", "<answer>y</answer>"),
        (2, "a", 0, "q2", None, "truth2", None),
    ]
    return spark.createDataFrame(rows, f"{KEY}, instruction string, context string, answer string, generation string")


def test_requests(generations):
    rows = {(r.row_id, r.model, r.sample, r.metric): r for r in judge.judge_requests(generations).collect()}
    assert len(rows) == 12
    asked = rows[1, "a", 0, "answer_correctness"]
    assert (asked.question, asked.answer, asked.expected, asked.context) == ("q1", "x", "x", None)
    asked = rows[1, "a", 0, "faithfulness"]
    assert (asked.answer, asked.expected, asked.context) == ("x", None, "c1")
    asked = rows[2, "a", 0, "faithfulness"]
    assert (asked.answer, asked.context) == ("", "")
    assert rows[1, "a", 0, "answer_relevancy"].context is None


def test_expected_answer(spark, generations):
    def expected(df, **options):
        rows = judge.judge_requests(df, **options).filter("metric = 'answer_correctness' AND model = 'b'").collect()
        return [r.expected for r in rows]

    assert expected(generations, on_missing="answer") == ["truth1"]
    given = generations.withColumn("expected_answer", F.lit("given"))
    assert expected(given, on_missing="answer") == expected(given) == ["given"]
    with pytest.raises(ValueError, match="on_missing"):
        judge.judge_requests(generations, on_missing="other")


def test_whole_response(generations):
    rows = judge.judge_requests(generations, "answer", whole_response=True).filter("model = 'b'").collect()
    assert {r.answer for r in rows} == {"<answer>y</answer>"}


def test_equal_questions_are_asked_once(generations):
    requests = judge.judge_requests(generations)
    once = judge.distinct_requests(requests)
    assert once.count() == 9
    assert once.select("request_id").distinct().count() == 9


def test_request_ids_tell_texts_apart(spark):
    rows = [
        (1, "m", 0, "a", "b|1:c", "t", "<answer>d</answer>"),
        (2, "m", 0, "a", "b", "t", "<answer>d</answer>"),
        (3, "m", 0, "a", "", "t", "<answer>d</answer>"),
    ]
    df = spark.createDataFrame(rows, f"{KEY}, instruction string, context string, answer string, generation string")
    assert judge.judge_requests(df).filter("metric = 'faithfulness'").select("request_id").distinct().count() == 3


def test_only_pending_requests_are_asked_and_all_askers_get_the_answer(generations):
    def lengths(batch):
        assert len(batch) <= 2
        return batch[["request_id", "metric"]].assign(score=batch["answer"].str.len().astype(float))

    requests = judge.judge_requests(generations)
    answered = requests.filter("metric = 'faithfulness'").select("request_id")
    answers = judge.batched_judge(requests, answered, lengths, batch_rows=2)
    assert answers.count() == 6
    back = judge.verdicts_of(requests, answers)
    rows = {(r.row_id, r.model, r.sample, r.metric): r.score for r in back.collect()}
    assert len(rows) == 8
    assert rows[1, "a", 0, "answer_correctness"] == rows[1, "a", 1, "answer_correctness"] == 1.0
    assert rows[2, "a", 0, "answer_relevancy"] == 0.0


def test_join_and_pass(spark, generations):
    verdicts = spark.createDataFrame(
        [(1, "a", 0, "faithfulness", 0.7), (1, "a", 0, "answer_relevancy", 0.69), (9, "a", 0, "faithfulness", 1.0)],
        f"{KEY}, metric string, score double",
    )
    rows = {(r.row_id, r.model, r.sample): r for r in judge.judge_pass(judge.attach_judge(generations, verdicts)).collect()}
    assert len(rows) == 4
    one = rows[1, "a", 0]
    assert (one.faithfulness, one.answer_correctness, one.judged) == (0.7, None, 2)
    assert (one.faithfulness_pass, one.answer_relevancy_pass) == (True, False)
    assert rows[2, "a", 0].judged == 0 and rows[2, "a", 0].faithfulness_pass is None


def test_contradictory_verdicts(spark, generations):
    rows = [
        (1, "a", 0, "faithfulness", 0.9, 1), (1, "a", 0, "faithfulness", 0.2, 2), (1, "a", 0, "faithfulness", None, 3),
        (1, "a", 0, "answer_relevancy", 0.5, 1), (1, "a", 0, "answer_relevancy", 0.5, 2),
        (1, "a", 0, "answer_correctness", 0.1, 7), (1, "a", 0, "answer_correctness", 0.3, 7), (1, "a", 0, "other", 1.0, 9),
        (1, "b", 0, "faithfulness", None, 1),
    ]
    verdicts = spark.createDataFrame(rows, f"{KEY}, metric string, score double, seq int")

    def judged(order):
        found = judge.attach_judge(generations, verdicts.repartition(3), order=order).collect()
        return {(r.row_id, r.model, r.sample): (r.faithfulness, r.answer_relevancy, r.answer_correctness, r.judged, r.judge_conflicts) for r in found}

    assert judged("seq")[1, "a", 0] == (0.2, 0.5, 0.3, 3, 2)
    assert judged(None)[1, "a", 0] == (0.9, 0.5, 0.3, 3, 2)
    assert judged("seq")[1, "b", 0] == judged("seq")[2, "a", 0] == (None, None, None, 0, 0)


def test_verdicts_of_has_one_row_a_request(spark, generations):
    requests = judge.judge_requests(generations, metrics=["faithfulness"])
    once = requests.select("request_id", "metric").distinct()
    answers = once.withColumns({"score": F.lit(0.25), "seq": F.lit(2)}).unionByName(once.withColumns({"score": F.lit(0.75), "seq": F.lit(1)}))
    assert {r.score for r in judge.verdicts_of(requests, answers).collect()} == {0.75}
    assert {r.score for r in judge.verdicts_of(requests, answers, order="seq").collect()} == {0.25}
    assert judge.verdicts_of(requests, answers).count() == requests.count() == 4


@pytest.fixture
def requests(spark):
    rows = [(i, "m", 0, f"q{i}", "c", "t", f"<answer>{i}</answer>") for i in range(200)]
    df = spark.createDataFrame(rows, f"{KEY}, instruction string, context string, answer string, generation string")
    return judge.judge_requests(df.repartition(3), metrics=["answer_relevancy"])


def asker(folder, fail_at=None):
    """Counts what it is asked in files, as the answers of a paid service would be."""
    folder = str(folder)

    def ask(batch):
        for request in batch["request_id"]:
            with open(f"{folder}/{request}", "a") as f:
                f.write("x")
            if fail_at and request.startswith(fail_at):
                raise RuntimeError("the judge is away")
        return batch[["request_id", "metric"]].assign(score=batch["question"].str.len().astype(float))

    return ask


def times_asked(folder):
    return Counter(len(open(f"{folder}/{f}").read()) for f in os.listdir(folder))


def test_a_run_that_ended_half_way_is_continued(requests, tmp_path):
    paid, log = tmp_path / "paid", str(tmp_path / "log")
    paid.mkdir()
    # 16 batches; the sixth is the first to fail
    with pytest.raises(Exception, match="the judge is away"):
        judge.ask_pending(requests, log, asker(paid, "5"), batch_rows=4, batch_requests=20)
    stored = AnswerLog(requests.sparkSession, log).answers().collect()
    assert {r.request_id[0] for r in stored} == set("01234")
    assert os.listdir(f"{log}/_claims") == [] or all(f.endswith(".crc") for f in os.listdir(f"{log}/_claims"))
    answers = judge.ask_pending(requests, log, asker(paid), batch_rows=4, batch_requests=20)
    assert answers.count() == answers.select("request_id").distinct().count() == 200
    counts = times_asked(paid)
    again = sum(1 for f in os.listdir(paid) if len(open(paid / f).read()) == 2)
    assert set(counts) <= {1, 2} and again == sum(1 for f in os.listdir(paid) if f[0] == "5" and len(open(paid / f).read()) == 2)
    # nothing is left to ask
    judge.ask_pending(requests, log, asker(paid), batch_rows=4)
    assert times_asked(paid) == counts
    verdicts = judge.verdicts_of(requests, answers)
    assert verdicts.count() == 200 and {r.score for r in verdicts.collect()} == {2.0, 3.0, 4.0}


def test_two_runs_at_once_pay_once(requests, tmp_path):
    paid, log, results = tmp_path / "paid", str(tmp_path / "log"), {}
    paid.mkdir()

    def run(name):
        results[name] = judge.ask_pending(requests, log, asker(paid), batch_rows=8, batch_requests=20).count()

    threads = [threading.Thread(target=run, args=(name,)) for name in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == {"a": 200, "b": 200}
    assert times_asked(paid) == {1: 200}


def test_claims_of_others_are_waited_for_and_given_up_when_old(requests, tmp_path):
    paid, log = tmp_path / "paid", str(tmp_path / "log")
    paid.mkdir()
    spark = requests.sparkSession
    with AnswerLog(spark, log).claim("") as ours:
        assert ours
        with pytest.raises(TimeoutError, match="1 batches"):
            judge.ask_pending(requests, log, asker(paid), patience=0.0)
        assert times_asked(paid) == {}
        assert judge.ask_pending(requests, log, asker(paid), claim_seconds=0.0).count() == 200
    # an abandoned run that stores its answers after all adds no second row
    late = AnswerLog(spark, log)
    late.store("", judge.distinct_requests(requests).select("request_id", "metric", F.lit(9.0).alias("score")))
    assert late.answers().count() == 200
