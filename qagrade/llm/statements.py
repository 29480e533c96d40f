"""DuckDB statements of the queries that SQL can state over whole tables."""

_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str, text: str, k: int) -> str:
    """Distinct shingles of `k` words; of fewer words all as one."""
    return f"""
    SELECT DISTINCT {key}, array_to_string(w[i:i + {k - 1}], ' ') AS s
    FROM (SELECT {key}, w, unnest(generate_series(1, greatest(len(w) - {k - 1}, 1))) AS i
          FROM (SELECT {key}, {_WORDS.format(text=text)} AS w FROM {table}) WHERE len(w) > 0)"""


OP2 = f"""
WITH RECURSIVE sh AS ({_shingles("documents", "doc_id", f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')", 4)}),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
          FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE 100 * c >= 85 * (na.n + nb.n - c)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents
                     UNION SELECT reach.doc_id, near.b FROM reach JOIN near ON near.a = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM win JOIN least USING (s) WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)"""

_RUNS = _WORDS.format(text="lower(coalesce(text, ''))")

OP5 = f"""
WITH ds AS ({_shingles("documents", "doc_id", "lower(coalesce(text, ''))", 5)}),
items AS (SELECT item_id, text, {_RUNS} AS w FROM benchmark),
long_items AS (SELECT item_id, text FROM items WHERE len(w) >= 5),
bs AS ({_shingles("long_items", "item_id", "lower(coalesce(text, ''))", 5)}),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
runs AS (SELECT doc_id, ' ' || array_to_string({_RUNS}, ' ') || ' ' AS t FROM documents)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item::DOUBLE AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0 FROM runs JOIN items ON contains(t, ' ' || array_to_string(w, ' ') || ' ')
WHERE len(w) BETWEEN 1 AND 4"""


#: CRC-32 of the decimal id, before its last complement.
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: ascii(CAST(doc_id AS VARCHAR)[i])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""


def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295::BIGINT) % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM leaves),
nodes(src, lvl, pos, h) AS (
  SELECT src, 0, pos, leaf FROM placed
  UNION ALL
  SELECT src, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM nodes) WHERE n > 1 GROUP BY src, lvl, pos // 16),
subroots AS (SELECT src, arg_max(h, lvl) AS h, max(lvl) AS height FROM nodes GROUP BY src),
tops(lvl, pos, h) AS (
  SELECT 0, src, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY lvl, pos // 16),
summit AS (SELECT arg_max(h, lvl) AS root, max(lvl) AS height FROM tops),
runs AS (SELECT src, lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM nodes GROUP BY ALL),
topruns AS (SELECT lvl, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM tops GROUP BY ALL),
steps AS (
  SELECT p.doc_id, p.leaf, p.changed, p.src, p.pos, r.lvl, r.hs, (p.pos // (16 ** r.lvl)::BIGINT) % 16 AS i
  FROM placed p JOIN subroots s USING (src) JOIN runs r ON r.src = p.src AND r.lvl < s.height AND r.run = p.pos // (16 ** (r.lvl + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, p.changed, p.src, p.pos, s.height + r.lvl, r.hs, (p.src // (16 ** r.lvl)::BIGINT) % 16
  FROM placed p JOIN subroots s USING (src) JOIN topruns r ON r.run = p.src // (16 ** (r.lvl + 1))::BIGINT, summit WHERE r.lvl < summit.height),
sides AS (SELECT src, pos, lvl, array_to_string(hs[1:i], '') AS l, array_to_string(hs[i + 2:16], '') AS r FROM steps),
proofs AS (SELECT src, pos, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256,
    list(l ORDER BY lvl) AS ls, list(r ORDER BY lvl) AS rs FROM sides GROUP BY src, pos),
paths AS (SELECT p.*, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
    coalesce(q.ls, []) AS ls, coalesce(q.rs, []) AS rs FROM placed p LEFT JOIN proofs q USING (src, pos)),
folds AS (SELECT *, list_reduce(list_concat([coalesce(changed, leaf)], list_transform(range(1, len(ls) + 1), lambda k: CAST(k AS VARCHAR))),
    lambda h, k: sha256(ls[CAST(k AS BIGINT)] || h || rs[CAST(k AS BIGINT)])) AS folded_root FROM paths)
SELECT f.doc_id, f.leaf, s.h AS subroot, summit.root, f.proof_sha256, f.folded_root, f.folded_root = summit.root AS verified
FROM folds f JOIN subroots s USING (src), summit"""

OP13 = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
same AS (SELECT lang, w, count(*) AS many FROM words WHERE len(w) > 0 GROUP BY ALL),
grams AS (SELECT lang, many, k, w[i:i + k - 1] AS g FROM (
    SELECT lang, w, many, k, unnest(generate_series(1, len(w) - k + 1)) AS i
    FROM same, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, sum(many)::BIGINT AS f FROM grams GROUP BY ALL HAVING sum(many) >= 30),
total AS (SELECT lang, sum(many * len(w))::BIGINT AS n FROM same GROUP BY lang),
cuts AS (SELECT lang, g, k, f AS a, unnest(generate_series(1, k - 1)) AS c FROM f WHERE k > 1),
scores AS (SELECT x.lang, x.g, x.k, x.a, c, y.f AS l, z.f AS r, ((2000000::HUGEINT * x.a) // (y.f::HUGEINT + z.f))::BIGINT AS score
    FROM cuts x JOIN f y ON y.lang = x.lang AND y.g = x.g[1:c] JOIN f z ON z.lang = x.lang AND z.g = x.g[c + 1:]),
weakest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inner_ AS (SELECT lang, g[i:i + len - 1] AS g, a FROM (
    SELECT lang, g, a, k, len, unnest(generate_series(1, k - len + 1)) AS i
    FROM (SELECT lang, g, a, k, unnest(generate_series(2, k - 1)) AS len FROM weakest WHERE k > 2))),
covers AS (SELECT lang, g, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN covers c USING (lang, g) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
JOIN total USING (lang) WHERE rank <= 2000"""

SQL: dict[str, str] = {"op2_ngram_join": OP2, "op4_substrings": OP4, "op5_contamination": OP5, "op11_merkle": OP11, "op13_collocations": OP13}
