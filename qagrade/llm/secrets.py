"""Secret scans behind a trigram index.

From each rule's regular expression follows a Boolean query over the trigrams that every match
has to contain: an OR over its alternatives of the AND of their trigrams. A segment of texts
(about a megabyte) gets an inverted index of the trigrams that occur in any query; postings are
intersected and united, and only the texts left are verified by the expression. A rule with an
alternative without trigrams is run over all texts. Segments live in their tasks, so nothing is
shuffled and a lost task is simply run again.

Spans are in code points, end exclusive, leftmost and non-overlapping within a kind. Defined
results: NULL and empty texts have no spans; rows repeat as they are; `scan` reads `doc_id` and
`text` alone, `redact` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as ops  # the names of the nodes of a parsed expression
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType

from qagrade.llm.common import lowered, narrow, slices

MAX_ALTERNATIVES = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, flags, and what a match must have to count."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, self.flags).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]


#: The three kinds whose spans are always reported as they are.
BASE = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE,
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Further published formats of keys.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

# --- queries -------------------------------------------------------------------------------

_GAP = None  # anything may stand here


def _sequences(parsed) -> list[list[str | None]]:
    """Alternatives of an expression, each a list of literal strings and gaps."""
    out: list[list[str | None]] = [[]]
    for op, value in parsed:
        if op is ops.LITERAL:
            more = [[chr(value)]]
        elif op is ops.IN and len(value) <= 8 and all(x[0] is ops.LITERAL for x in value):
            more = [[chr(x[1])] for x in value]
        elif op is ops.SUBPATTERN:
            more = _sequences(value[3])
        elif op is ops.BRANCH:
            more = [s for branch in value[1] for s in _sequences(branch)]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT):
            low, high, inner = value
            once = _sequences(inner)
            if (low, high) == (0, 1):
                more = [[], *once]
            else:
                more = [[*s, _GAP] for s in once] if low else [[_GAP]]
        elif op is ops.AT:
            more = [[]]
        else:
            more = [[_GAP]]
        if len(out) * len(more) > MAX_ALTERNATIVES:
            more = [[_GAP]]
        out = [a + b for a in out for b in more]
    return out


def trigram_query(rule: Rule) -> list[frozenset[bytes]] | None:
    """Alternatives, each the lower-case trigrams that all must occur; None if one has none."""
    query = set()
    for sequence in _sequences(parser.parse(rule.pattern, rule.flags)):
        grams, run = set(), ""
        for part in [*sequence, _GAP]:
            if part is not _GAP:
                run += part
                continue
            low = bytes(lowered(np.frombuffer(run.encode(), np.uint8)))
            grams |= {low[i : i + 3] for i in range(len(low) - 2)}
            run = ""
        if not grams:
            return None
        query.add(frozenset(grams))
    # an alternative whose trigrams contain another's adds nothing
    return [q for q in query if not any(o < q for o in query)]


class SegmentIndex:
    """Postings of the wanted trigrams over the texts of a segment."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, wanted: np.ndarray, table: np.ndarray):
        low = lowered(data).astype(np.int32)
        code = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(table[code])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pairs = np.unique(code[at[inside]].astype(np.int64) << 32 | doc[inside])
        bounds = np.searchsorted(pairs, wanted.astype(np.int64) << 32)
        ends = np.searchsorted(pairs, (wanted.astype(np.int64) + 1) << 32)
        self.postings = {
            int(w): pairs[a:b] & 0xFFFFFFFF for w, a, b in zip(wanted, bounds, ends, strict=True)
        }

    def texts(self, query: list[list[int]]) -> np.ndarray:
        """Numbers of the texts that a query leaves."""
        found = []
        for grams in query:
            lists = sorted((self.postings[g] for g in grams), key=len)
            left = lists[0]
            for other in lists[1:]:
                if not len(left):
                    break
                left = np.intersect1d(left, other, assume_unique=True)
            found.append(left)
        return np.unique(np.concatenate(found))


class Scanner:
    """All rules over segments of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        code = lambda g: g[0] << 16 | g[1] << 8 | g[2]
        queries = [trigram_query(r) for r in rules]
        self.queries = [None if q is None else [[code(g) for g in grams] for grams in q] for q in queries]
        self.wanted = np.array(sorted({g for q in self.queries if q for grams in q for g in grams}), np.int64)
        self.table = np.zeros(1 << 24, bool)
        self.table[self.wanted] = True

    def spans(self, column: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
        """Spans of each text, by start and then by the order of the rules."""
        for row, end, offsets, data in slices(column):
            index = SegmentIndex(offsets, data, self.wanted, self.table)
            texts: dict[int, str] = {}
            found: list[list] = [[] for _ in range(end - row)]
            for order, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
                for i in range(end - row) if query is None else index.texts(query).tolist():
                    if i not in texts:
                        texts[i] = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                    found[i] += [(a, order, b) for a, b in rule.spans(texts[i])]
            for own in found:
                yield [(self.rules[order].kind, a, b) for a, order, b in sorted(own)]


# --- operators -----------------------------------------------------------------------------

SPAN = "array<struct<kind: string, start: long, end: long>>"


def _each(docs: DataFrame, rules: tuple[Rule, ...], build: Callable, schema, text: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            yield build(batch, list(scanner.spans(batch.column(text))))

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans of every document."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def build(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    doc = docs.schema["doc_id"].dataType.simpleString()
    return _each(narrow(docs, "doc_id", "text"), rules, build, f"doc_id {doc}, spans {SPAN}", 1)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text, of every document."""
    base = [r.kind for r in BASE]

    def build(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        text = lambda own: ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        counts = [pa.array([sum(k == b for k, *_ in own) for own in spans], pa.int64()) for b in base]
        own_base = [hashlib.sha256(text([x for x in own if x[0] in base]).encode()).hexdigest() for own in spans]
        columns = [batch.column(0), *counts, pa.array(own_base), pa.array([text(own) for own in spans])]
        return pa.RecordBatch.from_arrays(
            columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        )

    doc = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return _each(narrow(docs, "doc_id", "text"), RULES, build, schema, 1)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, size_column: str | None = "n_chars") -> DataFrame:
    """`docs` with each stretch of spans replaced by its first kind in brackets. `size_column`, if it is
    a column of whole numbers, gets the new number of characters; others are left as they are, all
    of them with None. A NULL text stays NULL."""
    names = docs.columns
    sized = size_column in names and isinstance(docs.schema[size_column].dataType, IntegralType)
    at = names.index("text")

    def replaced(text: str, spans: list) -> str:
        out, done = [], 0
        for kind, a, b in spans:
            if a >= done:
                out += [text[done:a], f"[{kind}]"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def build(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        columns = list(batch.columns)
        if any(spans):
            texts = columns[at].to_pylist()
            new = [replaced(t, own) if own else t for t, own in zip(texts, spans, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if sized:
                n = names.index(size_column)
                sizes = [len(t) if own else s for t, own, s in zip(new, spans, columns[n].to_pylist(), strict=True)]
                columns[n] = pa.array(sizes, columns[n].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return _each(docs, rules, build, docs.schema, at)
