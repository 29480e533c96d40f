"""Headline timings: median of three runs after a warm-up, one JSON line.

The derived inputs are written once before the clock starts; every run reads them from
parquet and writes the result to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from qagrade.functions import vocab as V  # noqa: E402
from qagrade.operators import grade, parse, prompts, rewards, splits, summary  # noqa: E402
from qagrade.plans import fixtures  # noqa: E402
from qagrade.sources.scratch import pin, scope  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def session() -> SparkSession:
    shared = tempfile.mkdtemp(prefix="qagrade-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    tagged = pin(fixtures.tagged(spark, SF_DIR).repartition(16), "bench-tagged")
    generations = pin(fixtures.generations(spark, SF_DIR).repartition(16), "bench-generations")
    completions = pin(fixtures.completions(spark, SF_DIR).repartition(16), "bench-completions")
    verdicts = pin(fixtures.verdicts(spark, SF_DIR), "bench-verdicts")
    parsed = pin(parse.process_dataset(tagged, remove_output=True), "bench-parsed")
    eligible = splits.quality_filter(parsed)
    answers = generations.select("row_id", "model", "sample", "generation")
    eligible_rows = eligible.count()
    train, heldout = eligible_rows * 2 // 5, eligible_rows // 10

    work = {
        "parse": (lambda: parse.process_dataset(tagged), tagged),
        "label_distribution": (lambda: parse.label_distribution(parse.process_dataset(tagged)), tagged),
        "assemble_splits": (lambda: splits.assemble_splits(eligible, "row_id", train=train, heldout=heldout), parsed),
        "result_rows": (lambda: prompts.result_rows(parsed, answers), generations),
        "grade_generations": (
            lambda: grade.grade_generations(generations, verdicts).select("row_id", "model", "sample", *V.METRICS),
            generations,
        ),
        "reward_table": (lambda: rewards.reward_table(completions, verdicts), generations),
        "score_summary_by_model": (
            lambda: summary.score_summary(grade.grade_generations(generations, verdicts), "model"),
            generations,
        ),
    }
    seconds, rates = {}, {}
    for name, (build, rows_of) in work.items():
        rows = rows_of.count()
        times = []
        for _ in range(RUNS + 1):
            with scope():
                start = time.perf_counter()
                discard(build())
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        rates[name] = round(rows / seconds[name])
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows_per_sec": rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
