from __future__ import annotations

import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.sources import io
from qagrade.sources.scratch import pin, scope, scoped, scratch_path, unpin, use_folder


def plan(df):
    return df._jdf.queryExecution().toString()


def test_splits_are_pruned(spark, tmp_path):
    df = spark.range(30).select("id", F.element_at(F.array(F.lit("train"), F.lit("test"), F.lit("validation")), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    io.write_splits(df.repartition(8), str(tmp_path / "s"))
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=test", "split=validation"}
    one = io.read_table(spark, str(tmp_path / "s"), split="test")
    assert sorted(r.id for r in one.collect()) == list(range(1, 30, 3))
    assert "PartitionFilters: [isnotnull(split" in plan(one)
    # small draws do not leave a file per task
    assert len(list((tmp_path / "s" / "split=test").glob("*.parquet"))) == 1


def test_jsonl(spark, tmp_path):
    schema = "index long, messages array<struct<role:string,content:string>>, generation string"
    df = spark.createDataFrame([(2, [("user", "é\n\"")], None), (0, [], "b"), (1, None, "c")], schema)
    path = str(tmp_path / "j")
    io.write_jsonl(df.repartition(3), path, order_by=["index"])
    lines = [json.loads(x) for p in sorted(Path(path).glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert [x["index"] for x in lines] == [0, 1, 2]
    assert lines[2] == {"index": 2, "messages": [{"role": "user", "content": "é\n\""}], "generation": None}
    back = io.read_jsonl(spark, path, schema + ", expected_answer string")
    assert back.filter("expected_answer IS NOT NULL").count() == 0
    assert sorted(map(tuple, back.drop("expected_answer").collect())) == sorted(map(tuple, df.collect()))


def test_bad_line_is_an_error(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|bad_record|failfast"):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_score_file(spark, tmp_path):
    df = spark.createDataFrame([("m", 3, *([0.25] * len(V.METRICS)))], "model string, n long, " + ", ".join(f"{m} double" for m in V.METRICS))
    io.write_scores(df, str(tmp_path / "s"))
    (line,) = [x for p in (tmp_path / "s").glob("part-*") for x in p.read_text().splitlines()]
    written = json.loads(line)
    assert written["contextual-relevance_structure"] == written["answer-utility_structure"] == 0.25
    assert list(written) == ["model", "n", *[V.METRIC_LABELS.get(m, m) for m in V.METRICS]]
    assert io.read_jsonl(spark, str(tmp_path / "s"), io.score_schema()).first()["overall_score"] == 0.25


def test_scratch_is_below_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(folder)
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(bare, "x")
    use_folder("/named")
    assert scratch_path(bare, "x").startswith("/named/")
    use_folder(None)


def test_pinned_tables_can_be_deleted(spark):
    table = pin(spark.range(3), "gone")
    assert Path(table._pinned_at).exists()
    unpin(table)
    assert not Path(table._pinned_at).exists()


def test_a_scope_deletes_what_it_owns_but_for_what_a_result_reads(spark):
    @scoped
    def operator():
        inner = pin(spark.range(3), "inner")
        read = pin(inner.selectExpr("id + 1 AS id"), "read")
        operator.tables = (Path(inner._pinned_at), Path(read._pinned_at))
        return read.selectExpr("id * 2 AS id").filter("id > 2")

    with scope() as own:
        result = operator().withColumn("more", F.lit(1))
        inner, read = operator.tables
        assert not inner.exists() and read.exists() and len(own) == 1
        assert sorted(r.id for r in result.collect()) == [4, 6]
    assert not read.exists()


def test_a_scope_deletes_after_an_error_too(spark):
    with pytest.raises(RuntimeError), scope():
        path = Path(pin(spark.range(3), "x")._pinned_at)
        raise RuntimeError
    assert not path.exists()
