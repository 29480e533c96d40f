"""Licence scans: where texts repeat licence notices, by a suffix automaton of the notices' words.

One automaton has the word runs of all templates. A text is streamed through it word by word; the
state and the length at a word are its matching statistics: the longest run of words that ends there
and stands in some template. Runs that cannot go on and are long enough are matches; they are
chained, template by template, to spans in which text and template go forward together with small
gaps, so a notice with changed names or years is still one span. The share of the template's words that a
span covers decides on its label.

Only stretches in which each two neighbouring words are neighbours in a template are streamed: a
match has no others, and such stretches are rare. Phrases that make a label by themselves are read off
the same walk: one ends where its state is on the suffix path of the walk's state.

Words are runs of letters, digits and everything beyond ASCII, A-Z lowered, known by 64-bit hashes.
Templates are few and travel with the tasks; texts are not shuffled. Defined results: NULL and empty
texts have no words and no spans, NULL ids pass, repeated rows are rows of their own, and other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qagrade.llm.common import Words, lowered, narrow, slices
from qagrade.llm.licence_texts import PHRASES, TEMPLATES

#: Words of a match, or all of a shorter template.
LEAST = 4
#: Words that a chain may jump in the text between two matches.
GAP = 30
#: Share of a template that a span has to cover for its label.
COVER = 0.7

_BLANK = ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_SCREEN_BITS = 16
_U = np.uint64


def words_of(offsets: np.ndarray, data: np.ndarray) -> Words:
    return Words(offsets, lowered(data), _BLANK)


def hashes_of(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return words_of(np.array([0, len(data)]), data).hashes.tolist()


class SuffixAutomaton:
    """All word runs of several sequences; `step` follows a text."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: (sequence, end) of the prefixes that a state was made for.
        self.made: list[list[tuple[int, int]]] = [[]]
        for number, words in enumerate(sequences):
            last = 0
            for end, word in enumerate(words, 1):
                last = self._extend(last, word)
                self.made[last].append((number, end))

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.made.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A state for the shorter runs of `target` that `state` leads to by `word`."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:  # another sequence has this prefix
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest run that ends with `word`, after one that ended before it."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][word], length + 1

    def ends(self) -> list[list[tuple[int, int]]]:
        """Of each state, all (sequence, end) at which its runs stand."""
        out = [list(own) for own in self.made]
        for state in sorted(range(1, len(out)), key=self.length.__getitem__, reverse=True):
            out[self.link[state]] += out[state]
        return out


@dataclass(frozen=True)
class Span:
    """A stretch of a text that covers `covered` words of a template."""

    label: str
    template: int
    first: int
    end: int
    covered: int
    share: float


def _within(x: Span, y: Span) -> bool:
    """Whether another template explains the place better: a variant with more of the words there."""
    return y.first <= x.first and x.end <= y.end and y.covered > x.covered and y.share >= x.share


class Scanner:
    """The automaton of templates and phrases, and what stands before it."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], least: int, gap: int):
        self.least, self.gap = least, gap
        self.labels = [label for label, _ in (*templates, *phrases)]
        sequences = [hashes_of(text) for _, text in (*templates, *phrases)]
        self.sizes = [len(words) for words in sequences]
        if not all(self.sizes):
            raise ValueError("a template needs a word")
        self.automaton = SuffixAutomaton(sequences)
        self.ends = self.automaton.ends()
        #: Phrases that end in a state: those of its suffix path, with their sizes.
        self.phrases: list[list[int]] = [[] for _ in self.ends]
        self.first_phrase = len(templates)
        whole = {i: self._walk(words) for i, words in enumerate(sequences) if i >= self.first_phrase}
        for state in range(1, len(self.ends)):
            above = state
            while above > 0:
                self.phrases[state] += [i for i, end in whole.items() if end == above]
                above = self.automaton.link[above]
        self.shortest = min([least, *self.sizes])
        self.pairs = self._lookup({w for words in sequences for w in zip(words, words[1:])})
        self.single = np.array(sorted({words[0] for words in sequences if len(words) == 1}), _U)

    def _walk(self, words: Sequence[int]) -> int:
        state = length = 0
        for word in words:
            state, length = self.automaton.step(state, length, word)
        return state

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = a * _U(0x9E3779B97F4A7C15) ^ b
            return mixed ^ (mixed >> _U(29))

    def _lookup(self, pairs: set[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(sorted(pairs), _U).reshape(-1, 2)
        keys = np.unique(self._pair(both[:, 0], both[:, 1]))
        screen = np.zeros(1 << _SCREEN_BITS, bool)
        screen[keys & _U((1 << _SCREEN_BITS) - 1)] = True
        return keys, screen

    def stretches(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end) of the runs of words whose neighbours are a template's neighbours."""
        hashes = words.hashes
        if not len(hashes):
            return
        keys, screen = self.pairs
        joined = np.zeros(len(hashes) + 1, bool)  # the word and the one before it
        pair = self._pair(hashes[:-1], hashes[1:])
        maybe = np.flatnonzero(screen[pair & _U((1 << _SCREEN_BITS) - 1)])
        maybe = maybe[np.isin(pair[maybe], keys)]
        joined[maybe + 1] = words.doc[maybe] == words.doc[maybe + 1]
        inside = joined[:-1] | joined[1:]
        if len(self.single):
            inside |= np.isin(hashes, self.single)
        first = np.flatnonzero(inside & ~joined[:-1])
        end = np.flatnonzero(inside & ~joined[1:]) + 1
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            if b - a >= self.shortest:
                yield int(words.doc[a]), a, b

    def statistics(self, hashes: list[int]) -> list[tuple[int, int]]:
        """(state, length) at every word."""
        out, state, length = [], 0, 0
        for word in hashes:
            state, length = self.automaton.step(state, length, word)
            out.append((state, length))
        return out

    def matches(self, hashes: list[int], first: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """(start, phrase) of phrases, and (start, size, template, start in it) of matches that cannot
        go on, of a stretch whose first word is word `first` of its text."""
        walk = self.statistics(hashes)
        places, found = [], []
        for i, (state, length) in enumerate(walk):
            end = first + i + 1
            places += [(end - self.sizes[p], p) for p in self.phrases[state] if self.sizes[p] <= length]
            if length < self.shortest or (i + 1 < len(walk) and walk[i + 1][1] == length + 1):
                continue
            found += [
                (end - length, length, template, at - length)
                for template, at in self.ends[state]
                if length >= min(self.least, self.sizes[template])
            ]
        return places, found

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[Span]:
        """Chains of matches, best first, template by template; no match is in two, and a span inside
        that of a template which covers more there is left out."""
        out = []
        by: dict[int, list[tuple[int, int, int]]] = {}
        for start, size, template, at in found:
            by.setdefault(template, []).append((start, size, at))
        for template, own in by.items():
            own = sorted(set(own))
            reach = self.sizes[template] + self.gap
            score, before = [size for _, size, _ in own], [-1] * len(own)
            low = 0
            for j, (start, size, at) in enumerate(own):
                while own[low][0] + own[low][1] + reach < start:
                    low += 1
                for i in range(low, j):
                    start_i, size_i, at_i = own[i]
                    new = min(start + size - start_i - size_i, at + size - at_i - size_i, size)
                    near = start - start_i - size_i <= self.gap and at > at_i and start > start_i
                    if near and new > 0 and score[i] + new > score[j]:
                        score[j], before[j] = score[i] + new, i
            used = [False] * len(own)
            for j in sorted(range(len(own)), key=lambda j: (-score[j], j)):
                chain, i = [], j
                while i >= 0 and not used[i]:
                    chain.append(i)
                    i = before[i]
                if i >= 0 or not chain:  # part of a better chain
                    continue
                for i in chain:
                    used[i] = True
                first, end = own[chain[-1]][0], max(own[i][0] + own[i][1] for i in chain)
                covered = min(score[j], self.sizes[template])
                out.append(Span(self.labels[template], template, first, end, covered, covered / self.sizes[template]))
        return sorted((x for x in out if not any(_within(x, y) for y in out)), key=lambda s: (s.first, s.end, s.template))

    def scan(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], list[Span]]]:
        """Phrases and spans of the texts of a slice that have any."""
        hashes, raw = words.hashes, {}
        for doc, a, b in self.stretches(words):
            places, found = self.matches(hashes[a:b].tolist(), a - int(words.first[doc]))
            if places or found:
                own = raw.setdefault(doc, ([], []))
                own[0].extend(places)
                own[1].extend(found)
        return {doc: (places, self.spans(found)) for doc, (places, found) in raw.items()}


@functools.lru_cache(maxsize=4)
def scanner(
    templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = PHRASES, least: int = LEAST, gap: int = GAP
) -> Scanner:
    return Scanner(templates, phrases, least, gap)


_SPANS = "array<struct<label: string, template: int, first_word: int, end_word: int, covered: int, share: double>>"
_SCHEMA = f"n_words long, phrases array<struct<label: string, first_word: int>>, spans {_SPANS}"


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    least: int = LEAST,
    gap: int = GAP,
) -> DataFrame:
    """doc_id, n_words, all places of the phrases, and all spans with their template and share."""
    wanted = (tuple(templates), tuple(phrases), least, gap)
    doc = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(*wanted)
        places_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int32())]))
        spans_type = pa.list_(
            pa.struct(
                [("label", pa.string()), ("template", pa.int32()), ("first_word", pa.int32()), ("end_word", pa.int32()),
                 ("covered", pa.int32()), ("share", pa.float64())]
            )
        )
        for batch in batches:
            for row, end, offsets, data in slices(batch.column(1)):
                words = words_of(offsets, data)
                found = own.scan(words)
                places, spans = [], []
                for i in range(end - row):
                    p, s = found.get(i, ((), ()))
                    places.append([{"label": own.labels[x], "first_word": at} for at, x in p])
                    spans.append(
                        [{"label": x.label, "template": x.template, "first_word": x.first, "end_word": x.end, "covered": x.covered, "share": x.share} for x in s]
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array(np.diff(words.first).astype(np.int64)),
                        pa.array(places, places_type),
                        pa.array(spans, spans_type),
                    ],
                    ["doc_id", "n_words", "phrases", "spans"],
                )

    return narrow(docs, "doc_id", "text").mapInArrow(run, f"doc_id {doc}, {_SCHEMA}")


def labelled(docs: DataFrame, cover: float = COVER, **options) -> DataFrame:
    """doc_id, n_words, places of phrases in the text, their first and last, the labels they make,
    these and those of spans that cover enough of a template, and the best share of all spans."""
    rows = scan(docs, **options)
    starts = F.transform("phrases", lambda x: x["first_word"].cast("long"))
    own = F.transform("phrases", lambda x: x["label"])
    spanned = F.transform(F.filter("spans", lambda x: x["share"] >= cover), lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, spanned)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
