"""The table work round judge verdicts: requests, pending ones, joins and thresholds."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import tag_content
from qagrade.operators.answers import SCHEMA, AnswerLog, batch_of
from qagrade.operators.batched import BATCH_ROWS, batched_apply, batched_store
from qagrade.sources.scratch import pin, scope

GENERATION_KEY = ("row_id", "model", "sample")
REQUEST_COLUMNS = ("metric", "question", "answer", "expected", "context")


def _latest(order: str | None) -> Column:
    """The score that counts of several: that of the largest ``order``, of equal ones the largest."""
    score = F.struct(*([F.col(order).alias("_order")] if order else []), "score")
    return F.when(F.col("score").isNotNull(), score)


def wide_verdicts(verdicts: DataFrame, key: Sequence[str] = GENERATION_KEY, order: str | None = None) -> DataFrame:
    """Verdicts with one column per metric; one shuffle, combined before it.

    A generation may have been judged several times. The verdict with the largest ``order``, a
    number or time in the verdicts, counts; of those of equal order, and without one, the largest
    score. ``judge_conflicts`` is the number of metrics whose verdicts are not all equal. Rows
    without a score are no verdicts.
    """
    of = {m: F.col("metric") == m for m in V.VERDICTS}
    latest = [F.max(F.when(is_m, _latest(order)))["score"].alias(m) for m, is_m in of.items()]
    differ = [(F.min(F.when(is_m, F.col("score"))) < F.max(F.when(is_m, F.col("score")))).cast("int") for is_m in of.values()]
    conflicts = sum((F.coalesce(d, F.lit(0)) for d in differ), F.lit(0))
    return verdicts.groupBy(*key).agg(*latest, conflicts.alias("judge_conflicts"))


def attach_judge(
    df: DataFrame, verdicts: DataFrame, key: Sequence[str] = GENERATION_KEY, order: str | None = None
) -> DataFrame:
    """Add the three verdicts by key; ``judged`` counts those that are there, ``judge_conflicts``
    those that were contradicted, see :func:`wide_verdicts`.

    The key identifies a generation, so the join is one to one. Columns that are not used
    later, such as the text, do not take part in its shuffle.
    """
    judged = sum((F.col(m).isNotNull().cast("int") for m in V.VERDICTS), F.lit(0))
    joined = df.drop(*V.VERDICTS, "judge_conflicts").join(wide_verdicts(verdicts, key, order), list(key), "left")
    return joined.withColumns({"judged": judged, "judge_conflicts": F.coalesce("judge_conflicts", F.lit(0))})


def _request_id() -> Column:
    """Hash of what is asked. NULL and ``''`` differ, and no text can run into the next."""
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in REQUEST_COLUMNS]
    return F.md5(F.concat_ws("|", *parts))


def judge_requests(
    df: DataFrame,
    on_missing: str = "self",
    key: Sequence[str] = GENERATION_KEY,
    text_col: str = "generation",
    whole_response: bool = False,
    metrics: Sequence[str] = V.VERDICTS,
) -> DataFrame:
    """What to ask a judge, one row per generation and metric.

    Correctness gets question, answer and expected answer; faithfulness question, answer and
    context; relevancy question and answer. The expected answer is ``expected_answer``; when
    that column does not exist it is the extracted answer itself (``on_missing="self"``) or
    the ground truth in column ``answer`` (``on_missing="answer"``). The answer is what stands
    in the answer tag; ``whole_response`` asks about the whole text instead, as rewards do.
    ``metrics`` chooses what is asked; rewards need correctness only.
    Equal questions share a ``request_id``.
    """
    if on_missing not in ("self", "answer"):
        raise ValueError(f"on_missing is 'self' or 'answer', not {on_missing!r}")
    answer = F.col("_answer")
    if "expected_answer" in df.columns:
        expected = F.col("expected_answer")
    else:
        expected = answer if on_missing == "self" else F.col("answer")
    context = F.coalesce(F.col("context"), F.lit("")) if "context" in df.columns else F.lit("")
    nothing = F.lit(None).cast("string")

    def request(metric: str, expected: Column, context: Column) -> Column:
        values = (F.lit(metric), F.col("instruction"), answer, expected, context)
        return F.struct(*[v.alias(c) for v, c in zip(values, REQUEST_COLUMNS)])

    needs = {
        "answer_correctness": (expected, nothing),
        "faithfulness": (nothing, context),
        "answer_relevancy": (nothing, nothing),
    }
    asked = F.array(*[request(m, *needs[m]) for m in metrics])
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("_answer", text if whole_response else tag_content(text, "answer")).select(*key, F.inline(asked)).withColumn("request_id", _request_id())


def distinct_requests(requests: DataFrame) -> DataFrame:
    """Every question once, however many generations ask it.

    Copies are dropped before the shuffle as well as after it, so a question asked by very
    many generations costs one row per task. Equal ids mean equal rows, and comparing whole
    rows lets Spark drop them with a hash table instead of sorting the texts.
    """
    return requests.select("request_id", *REQUEST_COLUMNS).distinct()


def batched_judge(
    requests: DataFrame,
    answered: DataFrame,
    fn: Callable[..., pd.DataFrame],
    batch_rows: int = BATCH_ROWS,
    setup: Callable[[], Any] | None = None,
) -> DataFrame:
    """Ask ``fn`` for the requests that are not in ``answered`` yet: (request_id, metric, score).

    ``fn`` gets a frame of distinct requests and returns ``request_id``, ``metric`` and
    ``score``. Copies go first, so that the anti join meets every request once. The answers are
    stored before they are returned, so a second use does not ask again.
    """
    pending = distinct_requests(requests).join(answered.select("request_id").distinct(), "request_id", "left_anti")
    return batched_store(pending, fn, SCHEMA, "answers", batch_rows, setup)


def ask_pending(
    requests: DataFrame,
    answers_table: str,
    fn: Callable[..., pd.DataFrame],
    batch_rows: int = BATCH_ROWS,
    setup: Callable[[], Any] | None = None,
    batch_requests: int = 100_000,
    claim_seconds: float = 24 * 3600.0,
    patience: float = 3600.0,
) -> DataFrame:
    """Store the answers to pending requests in the log at ``answers_table`` and return all of it.

    The log is asked for and stored batch by batch, see :mod:`qagrade.operators.answers`: a run
    that ended half-way is continued by the next one, and runs at the same time share the work. A
    batch that another run has claimed is waited for, ``patience`` seconds without any progress at
    most. ``batch_requests`` sets the size of batches when the log is new.
    """
    log = AnswerLog(requests.sparkSession, answers_table, claim_seconds)
    with scope():
        known = log.answers().select("request_id")
        pending = pin(distinct_requests(requests).join(known, "request_id", "left_anti"), "pending")
        digits = log.digits(pending.count(), batch_requests)
        named = pending.withColumn("_batch", batch_of(F.col("request_id"), digits))
        waiting = sorted(r[0] for r in named.select("_batch").distinct().collect())
        since = time.monotonic()
        while waiting:
            left = []
            for batch in waiting:
                with log.claim(batch) as ours:
                    if not ours:
                        left.append(batch)
                        continue
                    rows = named.where(F.col("_batch") == batch).drop("_batch")
                    # what another run has stored since then
                    rows = rows.join(log.answers(batch).select("request_id"), "request_id", "left_anti")
                    if not rows.isEmpty():
                        log.store(batch, batched_apply(rows, fn, SCHEMA, batch_rows, setup))
                since = time.monotonic()
            waiting = left
            if waiting and time.monotonic() - since > patience:
                raise TimeoutError(f"other runs hold {len(waiting)} batches of {answers_table}")
            if waiting:
                time.sleep(min(1.0, patience))
    return log.answers()


def verdicts_of(
    requests: DataFrame, answers: DataFrame, key: Sequence[str] = GENERATION_KEY, order: str | None = None
) -> DataFrame:
    """Answers handed back to every generation that asked: (key, metric, score), one row a request.

    Of several answers to a request the one with the largest ``order`` counts, of equal ones, and
    without an order, the largest score.
    """
    asked = requests.select(*key, "metric", "request_id")
    once = answers.groupBy("request_id").agg(F.max(_latest(order))["score"].alias("score"))
    return asked.join(once, "request_id").select(*key, "metric", "score")


def judge_pass(df: DataFrame) -> DataFrame:
    """Add ``<metric>_pass`` for the metrics with a threshold; NULL without a verdict."""
    return df.withColumns({f"{m}_pass": F.col(m) >= F.lit(limit) for m, limit in V.PASS_THRESHOLDS.items()})
