"""The same results stated as DuckDB SQL.

Every statement starts from the derived inputs of :mod:`qagrade.plans.fixtures` and, where
it can, states the rule another way than the library does: positions instead of splits,
length differences instead of tag lists, window ranks instead of hash ends. Tokens, names and
the prompt stand here as text, so that a wrong value in the library shows.
"""

from __future__ import annotations

from qagrade.plans import fixtures

# White space at the ends of a text, tokens, tags, metrics and the prompt.
_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_GROUNDNESS_TOKENS = ["[No support / Contradictory]", "[Fully supported]", "[Partially supported]"]
_UTILITY_TOKENS = ["[Utility:1]", "[Utility:2]", "[Utility:3]", "[Utility:4]", "[Utility:5]"]
#: Tags and the columns that are named after them.
_TAGS = {
    "think": "think",
    "answer": "answer",
    "contextual-relevance": "contextual_relevance",
    "answer-utility": "answer_utility",
    "groundness": "groundness",
}
_STRUCTURE = [
    "think_structure",
    "answer_structure",
    "contextual_relevance_structure",
    "answer_utility_structure",
    "groundness_structure",
]
#: Metrics and the names under which they are written.
_METRICS = {
    "think_structure": "think_structure",
    "answer_structure": "answer_structure",
    "contextual_relevance_structure": "contextual-relevance_structure",
    "answer_utility_structure": "answer-utility_structure",
    "groundness_structure": "groundness_structure",
    "overall_structure_score": "overall_structure_score",
    "relevance_correct": "relevance_correct",
    "utility_correct": "utility_correct",
    "groundness_correct": "groundness_correct",
    "answer_correctness": "answer_correctness",
    "faithfulness": "faithfulness",
    "answer_relevancy": "answer_relevancy",
    "content_score": "content_score",
    "overall_score": "overall_score",
}
_SYSTEM_PROMPT = """Write these elements, one after the other, and nothing outside them:
<think>...</think>
<answer>...</answer>
<contextual-relevance>one token of the scale</contextual-relevance>
<answer-utility>one token of the scale</answer-utility>
<groundness>one token of the scale</groundness>

Ratings:
contextual-relevance: Would someone who has to answer the question want to read this context? Scale: [Relevant] > [Irrelevant]
answer-utility: How much of what was asked is settled once the answer is read? Scale: [Utility:5] > [Utility:4] > [Utility:3] > [Utility:2] > [Utility:1]
groundness: Which share of the statements in the answer can be checked against the context? Scale: [Fully supported] > [Partially supported] > [No support/Contradictory]
"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = _quote(_WHITESPACE)
_ID = "row_id, model, sample"
_TOKENS = ", ".join(_quote(t) for t in _GROUNDNESS_TOKENS + _UTILITY_TOKENS)
_GROUNDNESS = ", ".join(_quote(t) for t in _GROUNDNESS_TOKENS)
_UTILITY = ", ".join(_quote(t) for t in _UTILITY_TOKENS)


def _trim(expression: str) -> str:
    return f"trim({expression}, {_WS})"


def _content(tag: str, text: str = "generation") -> str:
    opening, closing = f"<{tag}>", f"</{tag}>"
    rest = f"substr({text}, strpos({text}, '{opening}') + {len(opening)})"
    return (
        f"CASE WHEN strpos({text}, '{opening}') > 0 AND strpos({rest}, '{closing}') > 0"
        f" THEN {_trim(f'''left({rest}, strpos({rest}, '{closing}') - 1)''')} ELSE '' END"
    )


def _count(token: str, text: str = "generation") -> str:
    return f"CAST((length({text}) - length(replace({text}, '{token}', ''))) // {len(token)} AS INTEGER)"


def _number(text: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({text}, '\\[Utility:([0-9]+)\\]', 1), '') AS HUGEINT), 0)"


def _same(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({a}, '') <> '' AND coalesce({b}, '') <> '' AND {_trim(a)} = {_trim(b)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _draws(p: str, train: str, held: str, test: str, sizes: str = "") -> dict[str, str]:
    """Draws by ranks: train on all rows, held out on what train left, halves by another seed."""
    also = f", {sizes}" if sizes else ""
    return {
        f"{p}strata": "SELECT relevance, count(*) AS n FROM eligible GROUP BY relevance",
        f"{p}train_shares": f"SELECT *, {train} * n // sum(n) OVER () AS share, ({train} * n) % sum(n) OVER () AS rest FROM {p}strata{also}",
        f"{p}train_quotas": f"""SELECT relevance, n, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, relevance)
            <= {train} - sum(share) OVER () THEN 1 ELSE 0 END AS train FROM {p}train_shares""",
        f"{p}held_shares": f"""SELECT *, {held} * (n - train) // sum(n - train) OVER () AS share,
            ({held} * (n - train)) % sum(n - train) OVER () AS rest FROM {p}train_quotas{also}""",
        f"{p}held_quotas": f"""SELECT relevance, train, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, relevance)
            <= {held} - sum(share) OVER () THEN 1 ELSE 0 END AS held FROM {p}held_shares""",
        f"{p}ranked": """SELECT *, row_number() OVER (PARTITION BY relevance
            ORDER BY md5('0:' || CAST(row_id AS VARCHAR)), row_id) AS rn FROM eligible""",
        f"{p}drawn": f"""SELECT r.*, CASE WHEN rn <= train THEN 'train' ELSE 'heldout' END AS split
            FROM {p}ranked r JOIN {p}held_quotas q USING (relevance) WHERE rn <= train + held""",
        f"{p}held_strata": f"SELECT relevance, count(*) AS m FROM {p}drawn WHERE split = 'heldout' GROUP BY relevance",
        f"{p}test_shares": f"SELECT *, {test} * m // sum(m) OVER () AS share, ({test} * m) % sum(m) OVER () AS rest FROM {p}held_strata{also}",
        f"{p}test_quotas": f"""SELECT relevance, m, share + CASE WHEN row_number() OVER (ORDER BY rest DESC, relevance)
            <= {test} - sum(share) OVER () THEN 1 ELSE 0 END AS test FROM {p}test_shares""",
        f"{p}reranked": f"""SELECT *, row_number() OVER (PARTITION BY relevance
            ORDER BY md5('1:' || CAST(row_id AS VARCHAR)), row_id) AS rn2 FROM {p}drawn WHERE split = 'heldout'""",
        f"{p}halved": f"""SELECT r.* EXCLUDE (split, rn2), CASE WHEN rn2 <= test THEN 'test' ELSE 'validation' END AS split
            FROM {p}reranked r JOIN {p}test_quotas q USING (relevance)""",
        f"{p}assembled": f"SELECT * FROM {p}halved UNION ALL SELECT * FROM {p}drawn WHERE split = 'train'",
    }


_CTES: dict[str, str] = {
    "tagged": fixtures.for_duckdb(fixtures.TAGGED_SQL),
    "generations": fixtures.for_duckdb(fixtures.GENERATIONS_SQL),
    "verdicts": fixtures.for_duckdb(fixtures.VERDICTS_SQL),
    "verdict_log": fixtures.for_duckdb(fixtures.VERDICT_LOG_SQL),
    # of several verdicts the last, of equally late ones the best
    "last_verdicts": """SELECT * FROM verdict_log
        QUALIFY row_number() OVER (PARTITION BY row_id, model, sample, metric ORDER BY seq DESC, score DESC) = 1""",
    "contradicted": """SELECT row_id, model, sample, count(*) AS conflicts FROM (
        SELECT row_id, model, sample, metric FROM verdict_log GROUP BY ALL HAVING count(DISTINCT score) > 1) GROUP BY ALL""",
    "gated": """SELECT * FROM tagged WHERE left(output, 11) = '[Retrieval]'
        AND strpos(output, '[No Retrieval]') = 0 AND strpos(output, '[Continue to Use Evidence]') = 0""",
    # parsing, by positions; rows that do not lead with the token get NULL
    "led": """SELECT *, CASE WHEN left(output, 11) = '[Retrieval]' THEN output END AS lead FROM tagged""",
    "opened": "SELECT *, strpos(lead, '<paragraph>') AS po FROM led",
    "closed": "SELECT *, CASE WHEN po > 0 THEN strpos(substr(lead, po + 11), '</paragraph>') ELSE 0 END AS pc FROM opened",
    "remainders": f"""SELECT *,
        CASE WHEN pc > 0 THEN {_trim("substr(lead, po + 11, pc - 1)")} END AS context,
        {_trim("CASE WHEN pc > 0 THEN substr(lead, po + pc + 22) ELSE substr(lead, 12) END")} AS remainder FROM closed""",
    "relevances": """SELECT *, CASE WHEN left(remainder, 10) = '[Relevant]' THEN '[Relevant]'
        WHEN left(remainder, 12) = '[Irrelevant]' THEN '[Irrelevant]' END AS relevance FROM remainders""",
    "bodies": f"SELECT *, {_trim('substr(remainder, 1 + coalesce(length(relevance), 0))')} AS body FROM relevances",
    "positions": f"""SELECT *,
        list_min(list_transform([{_TOKENS}], lambda t: nullif(strpos(body, t), 0))) AS pos FROM bodies""",
    "tokens": f"""SELECT *,
        list_filter([{_TOKENS}], lambda t: starts_with(substr(body, pos), t))[1] AS token FROM positions""",
    "cut": f"""SELECT *, CASE WHEN pos IS NULL THEN {_trim('body')} ELSE {_trim('left(body, pos - 1)')} END AS answer,
        {_trim('substr(body, pos + length(token))')} AS rest FROM tokens""",
    "every": f"""SELECT *,
        CASE WHEN relevance = '[Relevant]' AND token IN ({_GROUNDNESS}) THEN token END AS groundness,
        CASE WHEN relevance = '[Relevant]' AND token IN ({_GROUNDNESS}) THEN
               CASE {" ".join(f"WHEN contains(rest, {_quote(t)}) THEN {_quote(t)}" for t in _UTILITY_TOKENS)} END
             WHEN relevance IS NOT NULL AND token IN ({_UTILITY}) THEN token END AS utility FROM cut""",
    "parsed": "SELECT * FROM every WHERE row_id IN (SELECT row_id FROM gated)",
    "eligible": """SELECT * FROM parsed
        WHERE context IS NOT NULL AND length(context) > 300 AND relevance IS NOT NULL AND answer IS NOT NULL""",
    "big_sizes": """SELECT count(*) // 2 AS big_train, count(*) // 4 AS big_held,
        count(*) // 4 - count(*) // 4 // 2 AS big_test FROM eligible""",
    **_draws("", "100", "40", "20"),
    **_draws("big_", "big_train", "big_held", "big_test", "big_sizes"),
    # prompts
    "indexed": 'SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS "index" FROM parsed',
    "prompted": f"""SELECT *, {_quote(_SYSTEM_PROMPT)} AS system_text,
        'Question: ' || instruction || chr(10) || 'Answer it with the help of this context: ' || coalesce(context, '') AS user_text
        FROM indexed""",
    "rendered": """SELECT *, '<|system|>' || chr(10) || system_text || '<|end|>' || chr(10) || '<|user|>' || chr(10)
        || user_text || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) AS formatted_text FROM prompted""",
    "results": """SELECT r."index", r.row_id, r.instruction, r.context, r.relevance, r.answer, r.groundness, r.utility,
        r.formatted_text, g.model, g.sample, g.generation FROM rendered r LEFT JOIN generations g USING (row_id)""",
    # grading
    "said": f"""SELECT *, {_content("answer")} AS x_answer, {_content("contextual-relevance")} AS x_relevance,
        {_content("answer-utility")} AS x_utility, {_content("groundness")} AS x_groundness FROM generations""",
    "counted": "SELECT *, "
    + ", ".join(
        f"{_count(f'<{t}>')} AS {c}_open, {_count(f'</{t}>')} AS {c}_close" for t, c in _TAGS.items()
    )
    + " FROM said",
    "structured": "SELECT *, "
    + ", ".join(
        f"CAST({c}_open = 1 AND {c}_close = 1 AS INTEGER)::DOUBLE AS {c}_structure"
        for c in _TAGS.values()
    )
    + " FROM counted",
    "valued": f"""SELECT *, ({" + ".join(_STRUCTURE)}) / 5 AS overall_structure_score,
        {_number("x_utility")} AS x_value, {_number("utility")} AS e_value FROM structured""",
    "scored": f"""SELECT *, {_same("x_relevance", "relevance")} AS relevance_correct,
        {_same("x_groundness", "groundness")} AS groundness_correct,
        CASE WHEN x_utility = '' OR coalesce(utility, '') = '' OR x_value = 0 THEN 0.0
             ELSE greatest(0.0, 1.0 - abs(x_value - e_value) / 4.0) END::DOUBLE AS utility_correct,
        CASE WHEN x_utility = '' OR coalesce(utility, '') = '' THEN 0.0
             WHEN e_value = 0 THEN CAST({" OR ".join(f"contains(x_utility, 'Utility:{n}')" for n in range(1, 6))} AS INTEGER)
             WHEN x_value = 0 THEN 0.0
             ELSE greatest(0.0, 1.0 - abs(x_value - e_value) / 4.0) END::DOUBLE AS utility_reward FROM valued""",
    "judged": """SELECT s.*, v.answer_correctness, v.faithfulness, v.answer_relevancy,
        (v.answer_correctness IS NOT NULL)::INTEGER + (v.faithfulness IS NOT NULL)::INTEGER
          + (v.answer_relevancy IS NOT NULL)::INTEGER AS judged
        FROM scored s LEFT JOIN (
          SELECT row_id, model, sample, max(score) FILTER (metric = 'answer_correctness') AS answer_correctness,
            max(score) FILTER (metric = 'faithfulness') AS faithfulness,
            max(score) FILTER (metric = 'answer_relevancy') AS answer_relevancy
          FROM verdicts GROUP BY ALL) v USING (row_id, model, sample)""",
    "rejudged": """SELECT s.*, v.answer_correctness, v.faithfulness, v.answer_relevancy,
        (v.answer_correctness IS NOT NULL)::INTEGER + (v.faithfulness IS NOT NULL)::INTEGER
          + (v.answer_relevancy IS NOT NULL)::INTEGER AS judged, coalesce(c.conflicts, 0)::INTEGER AS judge_conflicts
        FROM scored s LEFT JOIN (PIVOT last_verdicts ON metric IN ('answer_correctness', 'faithfulness', 'answer_relevancy')
          USING any_value(score) GROUP BY row_id, model, sample) v USING (row_id, model, sample)
        LEFT JOIN contradicted c USING (row_id, model, sample)""",
    "contents": """SELECT *, (relevance_correct + utility_correct + groundness_correct
        + coalesce(answer_correctness, 0)) / 4 AS content_score FROM judged""",
    "graded": "SELECT *, (overall_structure_score + content_score) / 2 AS overall_score FROM contents",
    # judge requests
    "asked": """SELECT row_id, model, sample, 'answer_correctness' AS metric, instruction AS question,
          x_answer AS answer, answer AS truth, x_answer AS own, NULL AS context FROM said
        UNION ALL SELECT row_id, model, sample, 'faithfulness', instruction, x_answer, NULL, NULL, coalesce(context, '') FROM said
        UNION ALL SELECT row_id, model, sample, 'answer_relevancy', instruction, x_answer, NULL, NULL, NULL FROM said""",
    # rewards
    "rewarded": """SELECT *, 20 * coalesce(answer_correctness, 0) AS reward_correctness,
        10 * overall_structure_score AS reward_structure, 50 * relevance_correct AS reward_relevance,
        50 * groundness_correct AS reward_groundness, 100 * utility_reward AS reward_utility FROM judged""",
    "totalled": """SELECT *, reward_correctness + reward_structure + reward_relevance + reward_groundness
        + reward_utility AS reward_total FROM rewarded""",
    "advantaged": """SELECT *, CASE WHEN stddev_pop(reward_total) OVER g > 0
          THEN round((reward_total - avg(reward_total) OVER g) / stddev_pop(reward_total) OVER g, 6) ELSE 0 END AS advantage
        FROM totalled WINDOW g AS (PARTITION BY row_id, model)""",
}

# Which inputs a named table builds on, in the order of the dictionary above.
_ORDER = list(_CTES)


def _needed(statement: str) -> list[str]:
    """Names of the tables a statement uses, directly or through others."""
    used: set[str] = set()
    todo = [statement]
    while todo:
        words = set(todo.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in _ORDER:
            if name in words and name not in used:
                used.add(name)
                todo.append(_CTES[name])
    return [name for name in _ORDER if name in used]


def _with(statement: str) -> str:
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _needed(statement))
    return f"WITH {ctes}\n{statement}" if ctes else statement


def _means(labelled: bool = True) -> str:
    metrics = ", ".join(f"avg(coalesce({m}, 0)) AS {m}" for m in _METRICS)
    return f"""count(*) AS n, count(*) FILTER (judged = 3) AS judged_n, {metrics},
        avg(groundness_correct) FILTER (groundness IS NOT NULL) AS labelled"""


def _summary(keys: str) -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    rounded = ", ".join(f"CAST(printf('%.2f', {m}) AS DOUBLE) AS {m}, round({m}, 6) AS {m}_mean" for m in _METRICS)
    return f"""SELECT {keys} n, judged_n, {rounded}, round(labelled, 6) AS groundness_correct_labelled
        FROM (SELECT {keys} {_means()} FROM graded {group}) s"""


_LONG = "SELECT model, n, unnest([{names}]) AS metric, unnest([{values}]) AS mean FROM (SELECT model, {means} FROM graded GROUP BY model) s".format(
    names=", ".join(_quote(m) for m in _METRICS), values=", ".join(_METRICS), means=_means()
)
_FIVE = "context, relevance, answer, groundness, utility"

_BETWEEN = "|".join(f"<{t}>.*?</{t}>" for t in _TAGS)
_STEPS = [f"strpos(generation, '{m}')" for t in _TAGS for m in (f"<{t}>", f"</{t}>")]
_IN_ORDER = " AND ".join(f"{a} < {b}" for a, b in zip(_STEPS, _STEPS[1:]))

_ORDERED = f"""CASE WHEN {" AND ".join(f"{m} = 1" for m in _STRUCTURE)} AND {_IN_ORDER}
    AND {_trim(f"regexp_replace(generation, '(?s){_BETWEEN}', '', 'g')")} = ''
    THEN 1.0 ELSE 0.0 END::DOUBLE"""

_STATEMENTS: dict[str, str] = {
    "scan_tagged": "SELECT * FROM documents",
    "scan_split": "SELECT row_id, context, relevance, answer, split FROM assembled WHERE split = 'validation'",
    "sink_parsed": f"SELECT row_id, {_FIVE} FROM parsed",
    "sink_splits": f"SELECT row_id, {_FIVE}, split FROM assembled",
    "jsonl_roundtrip": f"""SELECT "index", row_id, {_FIVE}, CAST(NULL AS VARCHAR) AS expected_answer, formatted_text,
        'user' AS last_role, user_text AS last_content FROM rendered""",
    "sink_scores": "SELECT model, n, "
    + ", ".join(f"CAST(printf('%.2f', {m}) AS DOUBLE) AS \"{written}\"" for m, written in _METRICS.items())
    + f" FROM (SELECT model, {_means()} FROM graded GROUP BY model) s",
    "retrieval_gate": "SELECT row_id, output FROM gated",
    "extract_context": "SELECT row_id, context FROM parsed",
    "parse_remainder": "SELECT row_id, remainder FROM parsed",
    "extract_relevance": "SELECT row_id, relevance, body FROM parsed",
    "first_token": "SELECT row_id, token, CAST(pos AS INTEGER) AS position FROM parsed",
    "extract_answer": "SELECT row_id, answer FROM parsed",
    "extract_groundness": "SELECT row_id, groundness FROM parsed",
    "extract_utility": "SELECT row_id, utility FROM parsed",
    "parse_tagged": f"SELECT row_id, instruction, lang, source, output, {_FIVE} FROM every",
    "process_dataset": f"SELECT row_id, instruction, lang, source, {_FIVE} FROM parsed",
    "filter_audit": """SELECT count(*) AS rows_before, (SELECT count(*) FROM gated) AS rows_after,
        count(*) FILTER (output IS NULL) AS null_output,
        count(*) FILTER (output LIKE '%[No Retrieval]%') AS no_retrieval,
        count(*) FILTER (output LIKE '%[Continue to Use Evidence]%') AS continues_evidence,
        count(*) FILTER (output NOT LIKE '[Retrieval]%') AS not_leading FROM tagged""",
    "label_distribution": "SELECT relevance, groundness, utility, count(*) AS n FROM parsed GROUP BY ALL",
    "filter_has_context": "SELECT row_id, context FROM parsed WHERE context IS NOT NULL",
    "filter_min_context": "SELECT row_id, context FROM parsed WHERE length(context) > 300",
    "filter_has_relevance": "SELECT row_id, relevance FROM parsed WHERE relevance IS NOT NULL",
    "filter_has_answer": "SELECT row_id, answer FROM parsed WHERE answer IS NOT NULL",
    "class_encode": """SELECT row_id, relevance, CAST(dense_rank() OVER (ORDER BY relevance) - 1 AS BIGINT)
        AS relevance_class_label FROM eligible""",
    "stratum_quota": """SELECT source, n, CAST(share + CASE WHEN row_number() OVER (ORDER BY rest DESC, source)
          <= 100 - sum(share) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota
        FROM (SELECT *, 100 * n // sum(n) OVER () AS share, (100 * n) % sum(n) OVER () AS rest
              FROM (SELECT source, count(*) AS n FROM eligible GROUP BY source) c) s""",
    "stratified_split": "SELECT row_id, relevance, split FROM drawn",
    "split_holdout": "SELECT row_id, relevance, split FROM halved",
    "assemble_splits": f"SELECT row_id, instruction, lang, source, {_FIVE}, split FROM assembled",
    "split_balance": """SELECT split, relevance, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share
        FROM assembled GROUP BY split, relevance""",
    "split_overlap": """SELECT md5(CASE WHEN context IS NULL THEN '-' ELSE length(context) || ':' || context END) AS content,
        count(*) AS n, array_to_string(list_sort(list(DISTINCT s)), ',') AS splits
        FROM (SELECT *, CASE row_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'validation' END AS s FROM eligible)
        GROUP BY content HAVING count(DISTINCT s) > 1""",
    "split_overlap_drawn": """SELECT md5(length(context) || ':' || context) AS content, count(*) AS n,
        array_to_string(list_sort(list(DISTINCT split)), ',') AS splits
        FROM big_assembled GROUP BY content HAVING count(DISTINCT split) > 1""",
    "user_prompt": "SELECT row_id, user_text AS user_prompt, CAST(context IS NULL AS INTEGER) AS missing_inputs FROM prompted",
    "chat_messages": """SELECT row_id, 0 AS position, 'system' AS role, system_text AS content FROM prompted
        UNION ALL SELECT row_id, 1, 'user', user_text FROM prompted""",
    "conversation_messages": """SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages,
        first(coalesce(role, '') ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS first_role,
        last(coalesce(text, '') ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS last_content,
        string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), ''
          ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) || '<|assistant|>' || chr(10) AS formatted_text
        FROM conversations GROUP BY conv_id""",
    "row_index": """SELECT row_number() OVER (ORDER BY source, row_id) - 1 AS "index", source, row_id FROM parsed""",
    "render_chat": "SELECT row_id, formatted_text FROM rendered",
    "result_rows": f"""SELECT "index", {_ID}, instruction, {_FIVE}, formatted_text, generation FROM results""",
    "result_account": """SELECT row_id, CASE WHEN row_id IS NULL THEN 'no key' WHEN prompts = 0 THEN 'no prompt'
          WHEN generations = 0 THEN 'no generation' END AS problem, prompts, generations
        FROM (SELECT coalesce(p.row_id, g.row_id) AS row_id, coalesce(p.n, 0) AS prompts, coalesce(g.n, 0) AS generations
          FROM (SELECT CASE WHEN relevance IS NOT NULL THEN row_id END AS row_id, count(*) AS n FROM parsed GROUP BY 1) p
          FULL JOIN (SELECT row_id, count(*) AS n FROM generations WHERE generation <> '' AND model = 'base' AND sample = 0
            GROUP BY 1) g ON p.row_id = g.row_id) b
        WHERE row_id IS NULL OR prompts = 0 OR generations = 0""",
    "sample_preview": """SELECT "index", model, sample,
        CASE WHEN length(instruction) > 100 THEN left(instruction, 100) || '...' ELSE instruction END AS instruction,
        CASE WHEN length(generation) > 200 THEN left(generation, 200) || '...' ELSE generation END AS generation
        FROM results WHERE "index" = 0 OR "index" % 10 = 9""",
    "batched_apply": "SELECT row_id, '<answer>' || formatted_text || '</answer>' AS generation FROM rendered",
    "tag_content": f"SELECT {_ID}, " + ", ".join(f"{_content(t)} AS {c}" for t, c in _TAGS.items()) + " FROM generations",
    "tag_counts": f"SELECT {_ID}, "
    + ", ".join(f"{c}_{side}" for c in _TAGS.values() for side in ("open", "close"))
    + " FROM counted",
    "tag_structure": f"SELECT {_ID}, {', '.join(_STRUCTURE)} FROM structured",
    "structure_score": f"SELECT {_ID}, overall_structure_score FROM valued",
    "utility_value": f"SELECT {_ID}, CAST(x_value AS VARCHAR) AS extracted_value, CAST(e_value AS VARCHAR) AS expected_value FROM valued",
    "utility_grade": f"SELECT {_ID}, utility_correct FROM scored",
    "utility_grade_reward": f"SELECT {_ID}, utility_reward AS utility_correct FROM scored",
    "relevance_grade": f"SELECT {_ID}, relevance_correct FROM scored",
    "groundness_grade": f"""SELECT {_ID}, groundness_correct, CASE WHEN groundness_correct = 1
          OR (groundness IN ('[No support / Contradictory]', '[No support/Contradictory]')
              AND x_groundness IN ('[No support / Contradictory]', '[No support/Contradictory]'))
          THEN 1.0 ELSE 0.0 END::DOUBLE AS groundness_correct_normalized FROM scored""",
    "structure_order": f"SELECT {_ID}, {_ORDERED} AS structure_order FROM structured",
    "content_score": f"SELECT {_ID}, round(content_score, 6) AS content_score FROM graded",
    "overall_score": f"SELECT {_ID}, round(overall_score, 6) AS overall_score FROM graded",
    "grade_generations": f"SELECT {_ID}, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + " FROM graded",
    "judge_join": f"SELECT {_ID}, answer_correctness, faithfulness, answer_relevancy, judged FROM judged",
    "judge_conflicts": f"SELECT {_ID}, answer_correctness, faithfulness, answer_relevancy, judged, judge_conflicts FROM rejudged",
    "judge_requests": """SELECT DISTINCT metric, question, answer, truth AS expected, context,
        md5(concat_ws('|', length(metric) || ':' || metric, length(question) || ':' || question,
          length(answer) || ':' || answer, coalesce(length(truth) || ':' || truth, '-'),
          coalesce(length(context) || ':' || context, '-'))) AS request_id FROM asked""",
    "judge_pass": f"""SELECT {_ID}, faithfulness >= 0.7 AS faithfulness_pass,
        answer_relevancy >= 0.7 AS answer_relevancy_pass FROM judged""",
    "batched_judge": f"""SELECT {_ID}, metric, round(length(answer) / (length(answer) + length(question)), 6) AS score
        FROM asked WHERE metric <> 'answer_relevancy'""",
    "completion_text": f"SELECT {_ID}, generation, relevance, utility, groundness FROM generations",
    "reward_correctness": f"SELECT {_ID}, reward_correctness FROM rewarded",
    "reward_structure": f"SELECT {_ID}, reward_structure FROM rewarded",
    "reward_relevance": f"SELECT {_ID}, reward_relevance FROM rewarded",
    "reward_groundness": f"SELECT {_ID}, reward_groundness FROM rewarded",
    "reward_utility": f"SELECT {_ID}, reward_utility FROM rewarded",
    "reward_verdicts": f"""SELECT {_ID}, reward_faithfulness, reward_relevancy, reward_order, 20 * correct + 10 * overall_structure_score + 50 * relevance_correct
          + 50 * groundness_correct + 100 * utility_reward + 5 * reward_order + 30 * reward_faithfulness
          + 20 * reward_relevancy AS reward_total
        FROM (SELECT {_ID}, coalesce(answer_correctness, 0) AS correct, overall_structure_score, relevance_correct,
            groundness_correct, utility_reward, coalesce(faithfulness, 0) AS reward_faithfulness,
            coalesce(answer_relevancy, 0) AS reward_relevancy, {_ORDERED} AS reward_order FROM rejudged)""",
    "reward_total": f"SELECT {_ID}, reward_total FROM totalled",
    "group_advantage": f"SELECT {_ID}, advantage FROM advantaged",
    "reward_table": f"""SELECT {_ID}, reward_correctness, reward_structure, reward_relevance, reward_groundness,
        reward_utility, reward_total, advantage FROM advantaged""",
    "score_summary": _summary(""),
    "score_summary_by_model": _summary("model, "),
    "score_long": f"SELECT model, metric, round(mean, 6) AS mean, n FROM ({_LONG}) l",
    "model_compare": f"""SELECT metric, round(max(mean) FILTER (model = 'base'), 6) AS base,
        round(max(mean) FILTER (model = 'tuned'), 6) AS other,
        round(max(mean) FILTER (model = 'tuned') - max(mean) FILTER (model = 'base'), 6) AS difference
        FROM ({_LONG}) l GROUP BY metric""",
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(statement) for name, statement in _STATEMENTS.items()}
