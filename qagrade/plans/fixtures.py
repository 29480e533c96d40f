"""Input tables derived from ``documents`` and ``labels``.

No annotated corpus comes with the test data, so the three inputs of the library are
derived from the whole given tables. The statements are plain SQL that Spark and DuckDB
run to the same rows; the oracles start from the same text. ``{documents}`` and
``{labels}`` stand for the two tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ANSWER = (
    "concat('Source ', source, ' in ', lang, ' has ', CAST(n_chars AS STRING), ' characters (no. ',"
    " CAST(doc_id AS STRING), ').')"
)

# One annotated output per document; ``c`` picks the shape: 0-11 are the odd ones
# (control tokens, missing parts, tokens out of order, NULL), the rest are ordinary.
TAGGED_SQL = f"""
SELECT doc_id AS row_id,
  concat('What does document ', CAST(doc_id AS STRING), ' of ', source, ' say?') AS instruction,
  lang, source,
  CASE
    WHEN c = 0 THEN concat('[No Retrieval]', text, '[Utility:5]')
    WHEN c = 1 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Continue to Use Evidence]', ans, '[Utility:4]')
    WHEN c = 2 THEN concat(' [Retrieval]<paragraph>', text, '</paragraph>[Relevant]', ans, '[Fully supported][Utility:4]')
    WHEN c = 3 THEN concat('[Retrieval][Relevant]', text, '[Fully supported][Utility:3]')
    WHEN c = 4 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>', ans, '[Fully supported][Utility:2]')
    WHEN c = 5 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Irrelevant]', ans, '[Fully supported][Utility:2]')
    WHEN c = 6 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Relevant]', ans, '[Utility:4][Fully supported]')
    WHEN c = 7 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Relevant]', ans)
    WHEN c = 8 THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Relevant]', ans, '[Partially supported][Utility:5][Utility:2]')
    WHEN c = 9 THEN concat('[Retrieval]before', chr(10), '<paragraph> ', chr(9), text, chr(10), '</paragraph> ', chr(10),
                           '[Relevant] ', '\u2003', ans, '\u3000', ' [Fully supported] [Utility:1] ')
    WHEN c = 10 THEN '[Retrieval]drop me<paragraph></paragraph>[Relevant][Fully supported][Utility:1]'
    WHEN c = 11 THEN NULL
    WHEN doc_id % 3 = 1
      THEN concat('[Retrieval]<paragraph>', text, '</paragraph>[Irrelevant]', ans, '[Utility:', CAST(1 + doc_id % 5 AS STRING), ']')
    ELSE concat('[Retrieval]<paragraph>', text, '</paragraph>[Relevant]', ans,
                CASE doc_id % 4 WHEN 0 THEN '[Fully supported]' WHEN 1 THEN '[Partially supported]'
                                ELSE '[No support / Contradictory]' END,
                '[Utility:', CAST(1 + doc_id % 5 AS STRING), ']')
  END AS output
FROM (SELECT doc_id, text, lang, source, doc_id % 48 AS c, {_ANSWER} AS ans FROM {{documents}}) d
"""

def _generation(v: str, sample: str) -> str:
    return f"""CASE
    WHEN {v} = 3 THEN ''
    WHEN {v} = 4 THEN concat('<answer>', ans, '</answer><contextual-relevance>[Relevant]</contextual-relevance><answer-utility>[Utility:5]</answer-utility><groundness>[Fully supported]</groundness>')
    WHEN {v} = 5 THEN concat('<think>', text, '</think><answer>', ans, '</answer><answer>again</answer><contextual-relevance>[Relevant]</contextual-relevance><answer-utility>[Utility:5]</answer-utility><groundness>[Fully supported]</groundness>')
    WHEN {v} = 6 THEN concat('<answer>', ans, '</answer><think>', text, '</think><contextual-relevance>[Relevant]</contextual-relevance><answer-utility>[Utility:5]</answer-utility><groundness>[Fully supported]</groundness>')
    WHEN {v} = 7 THEN concat('Sure! <think>', text, '</think><answer>', ans, '</answer><contextual-relevance>[Relevant]</contextual-relevance><answer-utility>[Utility:12]</answer-utility><groundness>[Fully supported]</groundness>')
    WHEN {v} = 8 THEN concat('<think>', text, '</think><answer>', ans, '</answer><contextual-relevance>[relevant]</contextual-relevance><answer-utility>Utility:5</answer-utility><groundness>[Fully supported]')
    ELSE concat('<think>', chr(10), text, chr(10), '</think>', chr(10), '<answer>', chr(10), ans, chr(10), '</answer>', chr(10),
      '<contextual-relevance>', chr(10), '[Relevant]', chr(10), '</contextual-relevance>', chr(10),
      '<answer-utility>', chr(10), '[Utility:', CASE WHEN {v} = 9 THEN '100000000000000000000' ELSE CAST(1 + (doc_id + {sample}) % 5 AS STRING) END, ']', chr(10), '</answer-utility>', chr(10),
      '<groundness>', chr(10), CASE WHEN {v} = 2 THEN '[No support/Contradictory]' ELSE '[Fully supported]' END, chr(10), '</groundness>')
  END"""


def _labels(v: str) -> dict[str, str]:
    return {
        "relevance": f"CASE WHEN {v} IN (1, 12) THEN '[Irrelevant]' ELSE '[Relevant]' END",
        "utility": f"CASE WHEN {v} = 11 THEN NULL WHEN {v} = 10 THEN 'Utility unknown'"
        f" WHEN {v} = 9 THEN '[Utility:0099999999999999999998]'"
        " ELSE concat('[Utility:', CAST(doc_id % 5 + 1 AS STRING), ']') END",
        "groundness": f"CASE WHEN {v} = 1 THEN NULL WHEN {v} = 2 THEN '[No support / Contradictory]'"
        " ELSE '[Fully supported]' END",
    }


def _shape(sample: str) -> str:
    return f"((doc_id * 5 + CASE model WHEN 'base' THEN 0 ELSE 3 END + {sample} * 7) % 13)"


# Two models x four samples per document; ``v`` picks the shape: 1 mismatching labels,
# 2 the two spellings of one token, 3 empty, 4 tag missing, 5 tag doubled, 6 order
# swapped, 7 text outside and [Utility:12], 8 wrong case, no brackets and an unclosed
# tag, 10 and 11 unreadable or missing expected utility, 12 wrong relevance.
GENERATIONS_SQL = f"""
SELECT doc_id AS row_id, model, sample,
  concat('What does document ', CAST(doc_id AS STRING), ' of ', source, ' say?') AS instruction,
  text AS context,
  ans AS answer,
  {", ".join(f"{label} AS {name}" for name, label in _labels("v").items())},
  {_generation("v", "sample")} AS generation
FROM (
  SELECT *, {_shape("sample")} AS v
  FROM (
    SELECT *, {_ANSWER} AS ans, {{unnest}}({{list}}(0, 1, 2, 3)) AS sample
    FROM (SELECT *, {{unnest}}({{list}}('base', 'tuned')) AS model FROM {{documents}}) m
  ) s
) g
"""


def _per_sample(expression: str) -> str:
    return f"transform(array(0, 1, 2, 3), k -> {expression})"


# The generations as a trainer hands them over: per document and model an array of four
# completions, each a list of messages, with labels as arrays in the same order. Spark only.
COMPLETIONS_SQL = f"""
SELECT doc_id AS row_id, model,
  {_per_sample(f"array(named_struct('role', 'assistant', 'content', {_generation(_shape('k'), 'k')}))")} AS completions,
  {", ".join(f"{_per_sample(label)} AS {name}" for name, label in _labels(_shape("k")).items())}
FROM (SELECT *, {_ANSWER} AS ans, {{unnest}}({{list}}('base', 'tuned')) AS model FROM {{documents}}) m
"""

# Three verdicts per generation. Documents without a row in ``labels`` have no
# faithfulness verdict, so that the missing-verdict rule is exercised.
VERDICTS_SQL = """
SELECT row_id, model, sample, metric, CAST((row_id + sample + length(metric)) % 5 AS DOUBLE) / 4 AS score
FROM (
  SELECT *, {unnest}({list}('answer_correctness', 'faithfulness', 'answer_relevancy')) AS metric
  FROM (
    SELECT *, {unnest}({list}(0, 1, 2, 3)) AS sample
    FROM (
      SELECT d.doc_id AS row_id, l.doc_id IS NOT NULL AS labelled, {unnest}({list}('base', 'tuned')) AS model
      FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
    ) m
  ) s
) v
WHERE labelled OR metric <> 'faithfulness'
"""


# The verdicts as a log: some generations were judged again, with another score or the same one,
# and two judgements may have the same number.
VERDICT_LOG_SQL = f"""
SELECT row_id, model, sample, metric, score, 1 AS seq FROM ({VERDICTS_SQL}) one
UNION ALL
SELECT row_id, model, sample, metric, CAST((row_id * 3 + sample + length(metric)) % 5 AS DOUBLE) / 4 AS score,
  1 + CAST(row_id % 3 AS INT) AS seq
FROM ({VERDICTS_SQL}) two WHERE (row_id + sample) % 4 = 1
"""


def for_duckdb(statement: str) -> str:
    return statement.format(documents="documents", labels="labels", unnest="unnest", list="list_value")


def _for_spark(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    placeholders = {"documents": "{documents}", "labels": "{labels}"}
    text = statement.format(**placeholders, unnest="explode", list="array")
    tables = {
        name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name, mark in placeholders.items() if mark in text
    }
    return spark.sql(text, **tables)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_spark(spark, sf_dir, TAGGED_SQL)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_spark(spark, sf_dir, GENERATIONS_SQL)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_spark(spark, sf_dir, VERDICTS_SQL)


def verdict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_spark(spark, sf_dir, VERDICT_LOG_SQL)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _for_spark(spark, sf_dir, COMPLETIONS_SQL)
