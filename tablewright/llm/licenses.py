"""Licence scan with a generalised suffix automaton.

The automaton holds the words of all notices and phrases.  A text is streamed
through it once: after every word the state and length of the longest match that ends
there are known (its matching statistics).  A phrase stands wherever its state is an
ancestor of that state; matches that cannot grow any further are placed on the
notices and chained in the order of text and notice into covered spans.  A notice that
is covered to a set share gives its label.

Defined results
* words are runs of ASCII letters, digits and characters beyond ASCII, A-Z
  lower-cased; null text is empty: no words, no labels, score 0
* texts are judged one by one, so repeats and null ids get what their text gets
* score: 1 with a phrase, else the best covered share of a notice that gave a label, else 0
* an empty table gives an empty result; other columns are left alone
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.license_texts import NOTICES, PHRASES

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = 4  # words of a match that counts towards a notice
COVERED = 0.7  # share of a notice that gives its label
GAP = 12  # words a chain may pass over in the text


def words(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class Automaton:
    """Suffix automaton of several word sequences, with the ends of each state's matches in the notices."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[set] = [set()]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self._add(state, word)
                self.ends[state].add((number, place))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _state(self, size: int, nxt: dict, link: int) -> int:
        self.next.append(nxt), self.size.append(size), self.link.append(link), self.ends.append(set())
        return len(self.size) - 1

    def _split(self, last: int, word: int, old: int) -> int:
        """A state of its own for the shorter matches of ``old`` that end after ``last`` and ``word``."""
        copy = self._state(self.size[last] + 1, dict(self.next[old]), self.link[old])
        while last >= 0 and self.next[last].get(word) == old:
            self.next[last][word] = copy
            last = self.link[last]
        self.link[old] = copy
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier sequence went this way
            old = self.next[last][word]
            return old if self.size[old] == self.size[last] + 1 else self._split(last, word, old)
        new = self._state(self.size[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            old = self.next[last][word]
            self.link[new] = old if self.size[old] == self.size[last] + 1 else self._split(last, word, old)
        return new

    def walk(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES):
        self.phrase_labels = list(phrases.values())
        self.notice_labels = [label for label, texts in notices.items() for _ in texts]
        split = [words(p.encode()) for p in phrases]
        texts = [words(t.encode()) for group in notices.values() for t in group]
        self.number = {w: i for i, w in enumerate(dict.fromkeys(w for t in [*split, *texts] for w in t))}
        coded = [[self.number[w] for w in t] for t in [*split, *texts]]
        self.automaton = Automaton(coded)
        self.first_notice, self.notice_sizes = len(split), [len(t) for t in texts]
        ends = {self.automaton.walk(c): (i, len(c)) for i, c in enumerate(coded[: len(split)])}
        self.phrases_at: list[tuple] = [()] * len(self.automaton.size)  # phrases that end where a state's match ends
        for state in sorted(range(1, len(self.phrases_at)), key=self.automaton.size.__getitem__):
            up = self.phrases_at[self.automaton.link[state]]
            self.phrases_at[state] = (*up, ends[state]) if state in ends else up

    def statistics(self, numbers: list) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each known word."""
        nxt, link, size = self.automaton.next, self.automaton.link, self.automaton.size
        state = length = 0
        last = -2
        for place, word in numbers:
            if place != last + 1:
                state = length = 0
            last = place
            while state and word not in nxt[state]:
                state = link[state]
                length = size[state]
            if word in nxt[state]:
                state = nxt[state][word]
                length += 1
            yield place, state, length

    def scan(self, text: bytes | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans)."""
        found = words(text)
        known = [(i, n) for i, n in enumerate(map(self.number.get, found)) if n is not None]
        starts, base, matches = [], set(), []
        before = (-2, 0, 0)
        for here in self.statistics(known):
            place, state, length = here
            for phrase, size in self.phrases_at[state]:
                if size <= length:
                    starts.append(place - size + 1)
                    base.add(self.phrase_labels[phrase])
            if before[2] >= LONG and (place != before[0] + 1 or length <= before[2]):
                matches.append(before)
            before = here
        if before[2] >= LONG:
            matches.append(before)
        spans = self.chains(matches) if matches else []
        own = {self.notice_labels[n] for n, _, _, _ in spans}
        score = 1.0 if base else max((share for _, share, _, _ in spans), default=0.0)
        return (
            len(found), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(base | own)), score, spans,
        )

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(notice, covered share, first and last word in the text) of every notice that is covered well enough.

        ``open`` holds, for a notice, the chains that can still grow: their covered words, ends in
        text and notice, and start; a match extends the best one that lies before it in both.
        """
        best: dict[int, tuple] = {}
        open_: dict[int, list[tuple]] = {}
        for place, state, length in matches:
            for sequence, end in self.automaton.ends[state]:
                notice = sequence - self.first_notice
                if notice < 0:
                    continue
                rows = open_.setdefault(notice, [])
                rows[:] = [r for r in rows if r[1] >= place - length - GAP]
                choice = (length, place, end, place - length + 1)
                for covered, text_end, notice_end, start in rows:
                    new = min(length, place - text_end, end - notice_end)
                    if new > 0 and covered + new > choice[0]:
                        choice = (covered + new, place, end, start)
                rows.append(choice)
                best[notice] = max(best.get(notice, choice), choice)
        shares = ((n, c[0] / self.notice_sizes[n], c[3], c[1]) for n, c in sorted(best.items()))
        return [s for s in shares if s[1] >= COVERED]


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


COLUMNS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
SPANS = "spans array<struct<label:string, share:double, first_word:bigint, last_word:bigint>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = scanner()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    span = pa.list_(pa.struct([("label", pa.string()), ("share", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))
    for batch in batches:
        rows = [scan.scan(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        columns = list(zip(*rows)) or [()] * 8
        spans = [[dict(zip(("label", "share", "first_word", "last_word"), (scan.notice_labels[n], *rest))) for n, *rest in s] for s in columns[7]]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(spans, span)],
            names=["id", *(c.split()[0] for c in COLUMNS.split(", ")), "spans"],
        )


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, {COLUMNS}, {SPANS}")
    return rows.withColumnRenamed("id", id_col)
