from __future__ import annotations

import os
import subprocess
import sys

import pandas as pd
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.operators import prompts
from qagrade.operators.batched import batched_apply


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "row_id long, instruction string, context string")


def test_template_leaves_values_alone(spark):
    df = rows_of(spark, [(1, "a {context} {question} $1", "{question}"), (2, None, "c")])
    text = prompts.render_template("Q {question}|C {context}.", question=F.col("instruction"), context=F.col("context"))
    missing = prompts.missing_inputs(F.col("instruction"), F.col("context"))
    got = [tuple(r) for r in df.orderBy("row_id").select(text, missing).collect()]
    assert got == [("Q a {context} {question} $1|C {question}.", 0), ("Q |C c.", 1)]


def test_system_prompt_names_every_tag_and_token():
    for tag in V.TAGS:
        assert f"<{tag}>" in prompts.SYSTEM_PROMPT and f"</{tag}>" in prompts.SYSTEM_PROMPT
    for token in (*V.RELEVANCE_TOKENS, *V.UTILITY_TOKENS, V.FULLY_SUPPORTED, V.PARTIALLY_SUPPORTED, V.NO_SUPPORT_PROMPT):
        assert token in prompts.SYSTEM_PROMPT


def test_messages_and_rendering(spark):
    df = rows_of(spark, [(1, "q", "c")])
    messages = prompts.chat_messages(F.lit("be {brief}"), F.col("instruction"))
    rendered = prompts.render_chat(messages, opening="[{role}]", closing="[/]", reply_prefix="[assistant]")
    row = df.select(messages.alias("m"), rendered.alias("t")).first()
    assert [tuple(m) for m in row.m] == [("system", "be {brief}"), ("user", "q")]
    assert row.t == "[system]be {brief}[/][user]q[/][assistant]"


def test_result_rows(spark):
    df = rows_of(spark, [(30, "q3", "c"), (10, "q1", "c"), (20, "q2", None)]).withColumn("generation", F.lit("old"))
    generations = spark.createDataFrame(
        [(10, "a", 0, "x"), (10, "b", 0, "y"), (30, "a", 0, None), (99, "a", 0, "lost")],
        "row_id long, model string, sample int, generation string",
    )
    got = prompts.result_rows(df, generations)
    rows = sorted(((r["index"], r.row_id, r.model, r.generation) for r in got.collect()), key=str)
    assert rows == [(0, 10, "a", "x"), (0, 10, "b", "y"), (1, 20, None, None), (2, 30, "a", None)]
    assert all(len(r.messages) == 2 and r.formatted_text.endswith("<|assistant|>\n") for r in got.collect())


def test_preview(spark):
    df = spark.range(25).select(
        F.col("id").alias("index"), F.repeat(F.lit("é"), 101).alias("instruction"), F.lit("g").alias("generation")
    )
    rows = prompts.sample_preview(df).orderBy("index").collect()
    assert [r["index"] for r in rows] == [0, 9, 19]
    assert rows[0].instruction == "é" * 100 + "..." and rows[0].generation == "g"


def test_batches_and_setup(spark, tmp_path):
    log = str(tmp_path / "opened")

    def open_state():
        with open(log, "a") as f:
            f.write("x")
        return 100

    def add(batch: pd.DataFrame, state: int) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "v": batch["id"] + state, "n": len(batch)})

    rows = batched_apply(spark.range(50).repartition(2), add, "id long, v long, n int", batch_rows=7, setup=open_state).collect()
    assert sorted(r.id for r in rows) == list(range(50))
    assert all(r.v == r.id + 100 and r.n <= 7 for r in rows)
    assert len(open(log).read()) == 2


def test_conversations_in_order(spark):
    turns = [(1, 2, "user", "c"), (1, 0, "system", "a"), (1, 1, "user", "b"), (2, 0, "user", None), (None, 0, "user", "x"),
             (1, None, "first", "z"), (3, 1, "b", "same"), (3, 1, "a", "same"), (3, 1, "b", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("n_messages", F.lit("x"))
    rows = {r.conv_id: r for r in prompts.conversation_messages(df.repartition(4)).collect()}
    assert {k: [tuple(m) for m in r.messages] for k, r in rows.items()} == {
        1: [("first", "z"), ("system", "a"), ("user", "b"), ("user", "c")],
        2: [("user", "")],
        None: [("user", "x")],
        3: [("a", "same"), ("b", "same"), ("b", "same")],
    }
    assert all(r.n_messages == len(r.messages) for r in rows.values())
    with_system = prompts.conversation_messages(df.filter("conv_id = 2"), system="be brief").first()
    assert [tuple(m) for m in with_system.messages] == [("system", "be brief"), ("user", "")]
    assert prompts.conversation_messages(df.filter("turn > 9")).collect() == []


def test_one_very_long_conversation_is_gathered_by_segments(spark):
    n = 40_000
    hot = spark.range(n).select(F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rest = spark.range(300).select((F.col("id") % 100 + 10).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    got = prompts.conversation_messages(hot.unionByName(rest).repartition(5)).cache()
    (row,) = got.filter("conv_id = 7").collect()
    assert [m.content for m in row.messages] == [str(i) for i in range(n)]
    assert got.count() == 101 and {r.n_messages for r in got.filter("conv_id <> 7").collect()} == {3}
    # the aggregate below the last one has a row a segment: no key of it holds the conversation
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_segment" in plan


def test_result_account(spark):
    df = rows_of(spark, [(1, "q", "c"), (2, "q", "c"), (3, "q", "c"), (3, "q", "c"), (None, "q", "c")])
    generations = spark.createDataFrame([(1, "x"), (1, "y"), (9, "lost"), (None, "z"), (None, "z")], "row_id long, generation string")
    got = sorted(map(tuple, prompts.result_account(df, generations).collect()), key=str)
    assert got == [(2, "no generation", 1, 0), (3, "several prompts", 2, 0), (9, "no prompt", 0, 1), (None, "no key", 1, 2)]


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": batch["id"], "n": len(batch), "bytes": int(batch["t"].str.len().sum())})

    df = spark.range(40).select("id", F.when(F.col("id") == 5, F.repeat(F.lit("é"), 900)).otherwise(F.repeat(F.lit("x"), 100)).alias("t")).coalesce(1)
    rows = batched_apply(df, sizes, "id long, n int, bytes long", batch_rows=8, batch_bytes=500).collect()
    assert sorted(r.id for r in rows) == list(range(40))
    assert all(r.bytes <= 500 or r.n == 1 for r in rows) and max(r.n for r in rows) == 4
    assert [r.n for r in rows if r.id == 5] == [1]


FAILING = """
import os, sys
import pandas as pd
from pyspark.sql import SparkSession
from qagrade.operators.batched import batched_store

root = sys.argv[1]
spark = (SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", root + "/shared").getOrCreate())

def ask(batch):
    first = int(batch["id"].min())
    with open(f"{root}/asked-{first}", "a") as f:
        f.write("x")
    if 3 in set(batch["id"]) and len(open(f"{root}/asked-{first}").read()) < 3:
        raise RuntimeError("the model is away")
    return batch[["id"]].assign(n=len(batch))

rows = spark.range(100).coalesce(1)
got = batched_store(rows, ask, "id long, n long", "answers", batch_rows=10, batches_per_task=1)
for _ in range(2):
    assert sorted(r.id for r in got.collect()) == list(range(100))
"""


def test_finished_batches_are_not_asked_again_when_a_task_fails(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": root}
    subprocess.run([sys.executable, "-c", FAILING, str(tmp_path)], env=env, check=True, timeout=300)
    asked = sorted(len((tmp_path / f).read_text()) for f in os.listdir(tmp_path) if f.startswith("asked-"))
    assert asked == [1] * 9 + [3]
