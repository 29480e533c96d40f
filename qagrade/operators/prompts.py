"""Prompts, chat messages and result rows."""

from __future__ import annotations

from collections.abc import Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qagrade.functions import vocab as V
from qagrade.functions.text import clip
from qagrade.operators.index import placed, row_index
from qagrade.sources.scratch import pin, scoped

#: What is rated, the question a rater puts, and the tokens from best to worst. Callers may pass their own.
RATINGS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("contextual-relevance", "Would someone who has to answer the question want to read this context?", V.RELEVANCE_TOKENS),
    ("answer-utility", "How much of what was asked is settled once the answer is read?", tuple(reversed(V.UTILITY_TOKENS))),
    (
        "groundness",
        "Which share of the statements in the answer can be checked against the context?",
        (V.FULLY_SUPPORTED, V.PARTIALLY_SUPPORTED, V.NO_SUPPORT_PROMPT),
    ),
)


def system_prompt(ratings: Sequence[tuple[str, str, Sequence[str]]] = RATINGS) -> str:
    """The constant system text: the reply's form, then each rating with its scale on one line."""
    scales = {tag: " > ".join(tokens) for tag, _, tokens in ratings}
    form = "".join(f"<{tag}>{'one token of the scale' if tag in scales else '...'}</{tag}>\n" for tag in V.TAGS)
    lines = "".join(f"{tag}: {question} Scale: {scales[tag]}\n" for tag, question, _ in ratings)
    return f"Write these elements, one after the other, and nothing outside them:\n{form}\nRatings:\n{lines}"


SYSTEM_PROMPT = system_prompt()
USER_TEMPLATE = "Question: {question}\nAnswer it with the help of this context: {context}"


def render_template(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` fields with columns; NULL fills in as ``''``.

    The template is cut into its pieces first, so braces inside a value stay as they are.
    """
    pieces: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            pieces.append(F.coalesce(cols[field].cast("string"), F.lit("")))
    return F.concat(*pieces)


def missing_inputs(*cols: Column) -> Column:
    """How many of the template's columns are NULL in a row."""
    return sum((c.isNull().cast("int") for c in cols), F.lit(0))


def chat_messages(system: Column, user: Column) -> Column:
    """Two messages: system, then user."""
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )


def render_chat(
    messages: Column,
    opening: str = "<|{role}|>\n",
    closing: str = "<|end|>\n",
    reply_prefix: str = "<|assistant|>\n",
) -> Column:
    """Messages as one text that ends where the reply starts; the markers are parameters."""

    def rendered(message: Column) -> Column:
        return F.concat(render_template(opening, role=message["role"]), message["content"], F.lit(closing))

    return F.concat(F.concat_ws("", F.transform(messages, rendered)), F.lit(reply_prefix))


def add_prompts(df: DataFrame, system: str = SYSTEM_PROMPT, template: str = USER_TEMPLATE) -> DataFrame:
    """Add ``messages`` and ``formatted_text`` made from instruction and context."""
    user = render_template(template, question=F.col("instruction"), context=F.col("context"))
    with_messages = df.withColumn("messages", chat_messages(F.lit(system), user))
    return with_messages.withColumn("formatted_text", render_chat(F.col("messages")))


#: Bits of a turn's place that tell turns of one segment apart: 1024 of them.
_SEGMENT_BITS = 10


@scoped
def conversation_messages(
    df: DataFrame, group: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text", system: str | None = None
) -> DataFrame:
    """One row per conversation: ``group``, ``n_messages`` and ``messages`` in the order of its turns.

    All turns are dealt by ranges of conversation and turn, so a conversation of any length is
    sorted by many tasks. Neighbouring turns become segments of bounded size, and a
    conversation's row is put together from its segments: no task holds more of it than a
    segment but the one that writes its row. Turns of equal ``order`` stand by role and by a hash of their
    text, turns without one first; turns without a conversation are one conversation. NULL texts
    are empty messages. ``system`` adds a first message of that role.
    """
    names = {"_group": group, "_order": order, "role": role, "content": content}
    turns = df.select(*[F.col(c).alias(name) for name, c in names.items()]).withColumn("_tie", F.md5("content"))
    rows = placed(turns, ["_group", "_order", "role", "_tie"], "_place")
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    segment = F.shiftright("_place", _SEGMENT_BITS).alias("_segment")
    segments = rows.groupBy("_group", segment).agg(F.array_sort(F.collect_list(F.struct("_place", message.alias("m")))).alias("turns"))
    segments = segments.select("_group", "_segment", F.transform("turns", lambda t: t["m"]).alias("messages"))
    whole = segments.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_segment", "messages"))).alias("parts"))
    messages = F.flatten(F.transform("parts", lambda p: p["messages"]))
    if system is not None:
        first = F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))
        messages = F.concat(F.array(first), messages)
    whole = whole.select(F.col("_group").alias(group), messages.alias("messages"))
    return whole.select(group, F.size("messages").alias("n_messages"), "messages")


@scoped
def result_rows(df: DataFrame, generations: DataFrame, key: str = "row_id") -> DataFrame:
    """Prompt rows with index, messages, formatted text and their generations.

    ``key`` is unique and not NULL in ``df``. ``generations`` has the key, ``generation`` and
    any columns that tell generations of one prompt apart; same-named columns of ``df`` are
    overwritten. Prompts without a generation stay, with NULL; what has no partner on either
    side is listed by :func:`result_account`. Prompts are numbered by their
    keys alone, and those without a generation are found by keys alone, as stored narrow
    tables. The joins are plain shuffles, so that a prompt with very many generations is
    split at run time, which an outer join would not allow. Texts are rendered after them.
    ``generations`` is read for its keys and for its rows, so it should be a table.
    """
    overwritten = [c for c in generations.columns if c in df.columns and c != key]
    rows = df.drop(*overwritten)
    index = row_index(df.select(key).filter(F.col(key).isNotNull()), [key])
    waiting = pin(index.join(generations.select(key).distinct(), key, "left_anti"), "unanswered")
    answered = rows.join(index, key).join(generations, key)
    unanswered = rows.join(waiting, key)
    return add_prompts(answered.unionByName(unanswered, allowMissingColumns=True))


def result_account(df: DataFrame, generations: DataFrame, key: str = "row_id") -> DataFrame:
    """What :func:`result_rows` cannot pair: key, ``problem``, ``prompts`` and ``generations``.

    One row per key that has a problem, with how many rows of either side have it: ``no
    generation``, ``no prompt``, ``several prompts`` (keys have to be unique) and ``no key``.
    Only keys are read. Each side is counted before it is shuffled, so a key with very many
    generations is one row there.
    """
    sides = [
        table.groupBy(F.col(key)).agg(F.count("*").alias("_n")).withColumn("_side", F.lit(side))
        for table, side in ((df, "p"), (generations, "g"))
    ]
    n = lambda side: F.coalesce(F.sum(F.when(F.col("_side") == side, F.col("_n"))), F.lit(0))
    both = sides[0].unionByName(sides[1]).groupBy(key).agg(n("p").alias("prompts"), n("g").alias("generations"))
    problem = (
        F.when(F.col(key).isNull(), "no key")
        .when(F.col("prompts") == 0, "no prompt")
        .when(F.col("prompts") > 1, "several prompts")
        .when(F.col("generations") == 0, "no generation")
    )
    found = both.withColumn("problem", problem).filter(F.col("problem").isNotNull())
    return found.select(key, "problem", "prompts", "generations")


def sample_preview(df: DataFrame, every: int = 10) -> DataFrame:
    """Rows 1, 10, 20, ... with question and generation shortened for reading."""
    row = F.col("index") + 1
    return df.filter((row == 1) | (row % every == 0)).withColumns(
        {"instruction": clip(F.col("instruction"), 100), "generation": clip(F.col("generation"), 200)}
    )
