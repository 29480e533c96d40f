"""Annotated outputs to typed columns.

An annotated output reads
``[Retrieval]<paragraph>context</paragraph>[Relevant]answer[Fully supported][Utility:4]``.
The text is cut with ``split(..., 2)`` at the first paragraph pair and at the first closing
token. ``parse_tagged`` keeps the pieces in columns of their own between two projections,
so that every cut is made once per row however many outputs use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import any_of, strip

_CLOSING_TOKENS = any_of(V.GROUNDNESS_TOKENS + V.UTILITY_TOKENS)
_UTILITY_TOKENS = any_of(V.UTILITY_TOKENS)


def retrieval_gate(output: Column) -> Column:
    """TRUE for outputs to keep: retrieval leads and neither other control token occurs."""
    return (
        output.startswith(V.RETRIEVAL) & ~output.contains(V.NO_RETRIEVAL) & ~output.contains(V.CONTINUE_EVIDENCE)
    )


def _after_opening(output: Column) -> Column:
    """Text after the first paragraph marker; NULL without one or without the leading token."""
    return F.when(output.startswith(V.RETRIEVAL), F.get(F.split(output, V.PARAGRAPH_OPEN, 2), F.lit(1)))


def _paragraph_pieces(output: Column) -> Column:
    """``[inside, after]`` of the first paragraph pair; one element or NULL without a pair."""
    return F.split(_after_opening(output), V.PARAGRAPH_CLOSE, 2)


def _context_of(pieces: Column) -> Column:
    return F.when(F.size(pieces) == 2, strip(F.get(pieces, F.lit(0))))


def _remainder_of(output: Column, pieces: Column) -> Column:
    unpaired = F.when(output.startswith(V.RETRIEVAL), F.substr(output, F.lit(len(V.RETRIEVAL) + 1)))
    return strip(F.coalesce(F.get(pieces, F.lit(1)), unpaired))


def extract_context(output: Column) -> Column:
    """Context: NULL without a paragraph pair, ``''`` for an empty pair."""
    return _context_of(_paragraph_pieces(output))


def parse_remainder(output: Column) -> Column:
    """What follows the paragraph pair, or the leading token if there is no pair."""
    return _remainder_of(output, _paragraph_pieces(output))


def extract_relevance(remainder: Column) -> Column:
    """The relevance token the remainder starts with, else NULL."""
    relevance = F.lit(None).cast("string")
    for token in V.RELEVANCE_TOKENS:
        relevance = F.when(remainder.startswith(token), token).otherwise(relevance)
    return relevance


def answer_body(remainder: Column, relevance: Column | None = None) -> Column:
    """The remainder without its relevance token."""
    relevance = extract_relevance(remainder) if relevance is None else relevance
    return strip(F.substr(remainder, F.coalesce(F.length(relevance), F.lit(0)) + 1))


def _body_pieces(body: Column) -> Column:
    """``[before, after]`` of the first closing token; one element without a token."""
    return F.split(body, _CLOSING_TOKENS, 2)


def _closing_token(body: Column) -> Column:
    return F.nullif(F.regexp_extract(body, _CLOSING_TOKENS, 0), F.lit(""))


def first_token(body: Column) -> Column:
    """Struct of the earliest closing token and its 1-based position; NULL without one."""
    token = _closing_token(body)
    start = F.length(F.get(_body_pieces(body), F.lit(0))) + 1
    return F.when(token.isNotNull(), F.struct(token.alias("token"), start.alias("position")))


def _answer_of(pieces: Column) -> Column:
    return strip(F.get(pieces, F.lit(0)))


def _groundness_of(relevance: Column, token: Column) -> Column:
    return F.when((relevance == V.RELEVANT) & token.isin(*V.GROUNDNESS_TOKENS), token)


def _utility_of(relevance: Column, token: Column, pieces: Column) -> Column:
    later = F.array_min(F.regexp_extract_all(F.get(pieces, F.lit(1)), F.lit(_UTILITY_TOKENS), F.lit(0)))
    return F.when((relevance == V.RELEVANT) & token.isin(*V.GROUNDNESS_TOKENS), later).when(
        relevance.isNotNull() & token.isin(*V.UTILITY_TOKENS), token
    )


def extract_answer(body: Column) -> Column:
    """Text before the first closing token, or all of it."""
    return _answer_of(_body_pieces(body))


def extract_groundness(body: Column, relevance: Column) -> Column:
    """The first closing token if it is a groundness token of a relevant row."""
    return _groundness_of(relevance, _closing_token(body))


def extract_utility(body: Column, relevance: Column) -> Column:
    """The first closing token if it is a utility token, or the lowest one after groundness.

    On a relevant row whose first closing token is a groundness token, the lowest-numbered
    utility token after it counts, wherever it stands. An irrelevant row with a groundness
    token first has no utility.
    """
    return _utility_of(relevance, _closing_token(body), _body_pieces(body))


def parse_tagged(df: DataFrame, text_col: str = "output") -> DataFrame:
    """Add (or overwrite) context, relevance, answer, groundness and utility.

    All other columns pass through. Rows that do not lead with the retrieval token get
    NULL in all five.
    """
    output, pieces, remainder = F.col(text_col), F.col("_pieces"), F.col("_remainder")
    relevance, body, parts, token = F.col("_relevance"), F.col("_body"), F.col("_parts"), F.col("_token")
    staged = (
        df.withColumn("_pieces", _paragraph_pieces(output))
        .withColumn("_remainder", _remainder_of(output, pieces))
        .withColumn("_relevance", extract_relevance(remainder))
        .withColumn("_body", answer_body(remainder, relevance))
        .withColumns({"_parts": _body_pieces(body), "_token": _closing_token(body)})
    )
    return staged.withColumns(
        {
            "context": _context_of(pieces),
            "relevance": relevance,
            "answer": _answer_of(parts),
            "groundness": _groundness_of(relevance, token),
            "utility": _utility_of(relevance, token, parts),
        }
    ).drop("_pieces", "_remainder", "_relevance", "_body", "_parts", "_token")


def process_dataset(df: DataFrame, remove_output: bool = False) -> DataFrame:
    """Gate, then parse; the ``output`` column is dropped on request."""
    parsed = parse_tagged(df.filter(retrieval_gate(F.col("output"))))
    return parsed.drop("output") if remove_output else parsed


def filter_audit(df: DataFrame) -> DataFrame:
    """Rows before and after the gate and how many fail each of its conditions, in one pass."""
    output = F.col("output")
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(retrieval_gate(output)).alias("rows_after"),
        F.count_if(output.isNull()).alias("null_output"),
        F.count_if(output.contains(V.NO_RETRIEVAL)).alias("no_retrieval"),
        F.count_if(output.contains(V.CONTINUE_EVIDENCE)).alias("continues_evidence"),
        F.count_if(~output.startswith(V.RETRIEVAL)).alias("not_leading"),
    )


def label_distribution(df: DataFrame) -> DataFrame:
    """Rows per combination of relevance, groundness and utility."""
    return df.groupBy("relevance", "groundness", "utility").agg(F.count("*").alias("n"))
