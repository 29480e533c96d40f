"""Fixed vocabularies of the data format.

Everything in this module is a fixed value: the markers have to equal the ones found in
the annotated texts and in the generations, or nothing would match.
"""

from __future__ import annotations

# Control tokens of an annotated output.
RETRIEVAL = "[Retrieval]"
NO_RETRIEVAL = "[No Retrieval]"
CONTINUE_EVIDENCE = "[Continue to Use Evidence]"

# The pair of markers round the context.
PARAGRAPH_OPEN = "<paragraph>"
PARAGRAPH_CLOSE = "</paragraph>"

# Relevance tokens.
RELEVANT = "[Relevant]"
IRRELEVANT = "[Irrelevant]"
RELEVANCE_TOKENS = (RELEVANT, IRRELEVANT)

# Groundness tokens as the annotated data spells them.
NO_SUPPORT = "[No support / Contradictory]"
FULLY_SUPPORTED = "[Fully supported]"
PARTIALLY_SUPPORTED = "[Partially supported]"
GROUNDNESS_TOKENS = (NO_SUPPORT, FULLY_SUPPORTED, PARTIALLY_SUPPORTED)

# Fixed value: the prompt asks for this spelling of NO_SUPPORT, without the blanks.
NO_SUPPORT_PROMPT = "[No support/Contradictory]"

# Utility tokens, worst to best.
UTILITY_TOKENS = tuple(f"[Utility:{n}]" for n in range(1, 6))

# Columns that parsing adds.
PARSED_COLUMNS = ("context", "relevance", "answer", "groundness", "utility")

# Tags of a generation, in the order in which they have to appear.
TAGS = ("think", "answer", "contextual-relevance", "answer-utility", "groundness")

# Verdict names and the thresholds at which a verdict counts as passed.
VERDICTS = ("answer_correctness", "faithfulness", "answer_relevancy")
PASS_THRESHOLDS = {"faithfulness": 0.7, "answer_relevancy": 0.7}

# Reward at a grade of 1.0.
REWARD_SCALES = {
    "correctness": 20.0,
    "structure": 10.0,
    "relevance": 50.0,
    "groundness": 50.0,
    "utility": 100.0,
}

# The 29 characters that count as whitespace at either end of a text.
WHITESPACE = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)

# Sizes of the published subset.
TRAIN_ROWS = 100
HELDOUT_ROWS = 40
MIN_CONTEXT_CHARS = 300


def column_name(tag: str) -> str:
    """Tag name as a column name (hyphens are awkward in SQL)."""
    return tag.replace("-", "_")


# The 14 metrics of a graded generation, as column names.
STRUCTURE_METRICS = tuple(f"{column_name(t)}_structure" for t in TAGS)
CONTENT_METRICS = ("relevance_correct", "utility_correct", "groundness_correct", "answer_correctness")
METRICS = (
    *STRUCTURE_METRICS,
    "overall_structure_score",
    *CONTENT_METRICS,
    "faithfulness",
    "answer_relevancy",
    "content_score",
    "overall_score",
)

# Names under which the metrics are written to a score file.
METRIC_LABELS = {f"{column_name(t)}_structure": f"{t}_structure" for t in TAGS}
