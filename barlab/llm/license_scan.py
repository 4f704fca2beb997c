"""License scans with a generalised suffix automaton of license texts.

The automaton holds every run of words of every template. A file streams through it word by word, which gives at each
place the longest run that ends there and occurs in a template; maximal runs are chained, template by template, into
covered spans, each run after the open chain with which it covers most. A template counts as present when enough of it
is covered. Bodies of long licenses share passages, so only longer runs join their chains, and of stretches that overlap the
body that covers most counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import PHRASES, TEMPLATES, bodies

#: Shortest run of words that may join a chain, words that a chain may skip, and the part of a template to be covered.
SHORTEST, SKIP, COVERED = 3, 8, 0.75
#: So many covered words are enough in a long template.
ENOUGH = 40
#: The same of whole bodies: the shortest run, and words that are enough.
BODY_RUN, BODY_ENOUGH = 6, 150

_BLANK = bytes(b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return (text or "").encode().translate(_BLANK).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places (template, word) where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((t, place))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            ends[self.link[state]] += ends[state]
        self.ends = [sorted(set(e)) for e in ends]

    def _state(self, length: int, moves: dict[int, int], link: int, ends: list) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int, ends: list) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], ends)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: int, ends: list) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q, ends)
        new, p = self._state(self.length[last] + 1, {}, 0, ends), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q, ends)
        return new


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, whole: tuple[tuple[str, str], ...] = ()):
        every, self.first_body = (*templates, *whole), len(templates)
        self.labels = [label for label, _ in every]
        split = [words_of(text) for _, text in every]
        self.sizes = [len(words) for words in split]
        self.word_id = {w: i for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.automaton = Automaton([[self.word_id[w] for w in words] for words in split])
        ends = self.automaton.ends
        self.in_templates = [[e for e in own if e[0] < self.first_body] for own in ends] if whole else ends
        self.in_bodies = [[e for e in own if e[0] >= self.first_body] for own in ends] if whole else None

    def maximal_runs(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(last word, length, state) of each run of at least SHORTEST words that occurs in a template and can't go on."""
        moves, link, longest = self.automaton.next, self.automaton.link, self.automaton.length
        out, state, size, known = [], 0, 0, self.word_id.get
        for place, word in enumerate(words):
            i = known(word)
            if i is None:
                if size >= SHORTEST:
                    out.append((place - 1, size, state))
                state = size = 0
                continue
            to = moves[state].get(i)
            if to is None:
                if size >= SHORTEST:
                    out.append((place - 1, size, state))
                while state and to is None:
                    state = link[state]
                    size = longest[state]
                    to = moves[state].get(i)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
        if size >= SHORTEST:
            out.append((len(words) - 1, size, state))
        return out

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """(label, first word, last word, words covered, words of the template) of each template that is present, once
        for each stretch of the file that covers enough of it; stretches of one template don't overlap."""
        places: dict[int, list[tuple[int, int, int]]] = {}
        for last, size, state in self.maximal_runs(words):
            for t, end in self.in_templates[state]:
                places.setdefault(t, []).append((last, size, end))
            if size >= BODY_RUN and self.in_bodies:
                for t, end in self.in_bodies[state]:
                    places.setdefault(t, []).append((last, size, end))
        out, of_bodies = [], []
        for t, own in places.items():
            body = t >= self.first_body
            need = min(COVERED * self.sizes[t], BODY_ENOUGH if body else ENOUGH)
            if sum(size for _, size, _ in own) >= need:
                (of_bodies if body else out).extend((self.labels[t], *stretch, self.sizes[t]) for stretch in best_chains(own, need))
        kept: list[tuple[str, int, int, int, int]] = []
        for s in sorted(of_bodies, key=lambda s: (-s[3], s)):
            if all(s[2] < k[1] or s[1] > k[2] for k in kept):
                kept.append(s)
        return sorted(out + kept)


def best_chains(places: list[tuple[int, int, int]], need: float) -> list[tuple[int, int, int]]:
    """``places``: (last word, words, end in the template) of one template's runs, by last word. Two runs follow each
    other where both file and template go on, over gaps of at most SKIP words; words of an overlap count once. Returns
    (first word, last word, words covered) of the chains that cover at least ``need``, the best first, those that overlap
    a better one left out."""
    covered, firsts, low = [], [], 0
    for i, (last, size, end) in enumerate(places):
        first, begin = last - size + 1, end - size + 1
        while low < i and places[low][0] + 1 + SKIP < first:  # first words never fall, so these are closed for good
            low += 1
        best, start = size, first
        for j in range(low, i):
            before, _, stop = places[j]
            if before < last and stop < end and begin <= stop + 1 + SKIP:
                total = covered[j] + min(size, last - before, end - stop)
                if total > best:
                    best, start = total, firsts[j]
        covered.append(best)
        firsts.append(start)
    out: list[tuple[int, int, int]] = []
    for i in sorted((i for i, n in enumerate(covered) if n >= need), key=lambda i: (-covered[i], firsts[i], places[i][0])):
        first, last = firsts[i], places[i][0]
        if all(last < a or first > b for a, b, _ in out):
            out.append((first, last, covered[i]))
    return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(TEMPLATES, bodies())


_PHRASE = re.compile(rb"(?<= )(?=(" + b"|".join(p.encode() for p in PHRASES) + rb") )")


def phrase_places(words: list[bytes]) -> list[tuple[int, int, str]]:
    """(first word, last word, label) of every place where a phrase's words stand consecutively."""
    if b"license" not in words:
        return []
    line = b" " + b" ".join(words) + b" "
    out, at, seen = [], 0, 0
    for m in _PHRASE.finditer(line):
        seen += line.count(b" ", at, m.start())
        at = m.start()
        phrase = m[1].decode()
        out.append((seen - 1, seen - 1 + phrase.count(" "), PHRASES[phrase]))
    return out


def scanned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, places (array of first, last, label: the base phrases) and spans (array of
    label, first, last, covered, size: templates present). Null and empty texts have neither. Repeated rows and rows without
    an id are answered each; other columns are ignored; an empty table gives no rows."""
    span = "struct<label:string,first:bigint,last:bigint,covered:bigint,size:bigint>"
    schema = f"doc_id bigint, n_words bigint, places array<struct<first:bigint,last:bigint,label:string>>, spans array<{span}>"
    of = lambda *fields: pa.list_(pa.struct([(n, pa.string() if n == "label" else pa.int64()) for n in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                sizes, places, spans = [], [], []
                for t in batch.column(1).to_pylist():
                    words = words_of(t)
                    sizes.append(len(words))
                    places.append([dict(zip(("first", "last", "label"), x)) for x in phrase_places(words)])
                    spans.append([dict(zip(("label", "first", "last", "covered", "size"), x)) for x in scan.spans(words)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(places, of("first", "last", "label")),
                     pa.array(spans, of("label", "first", "last", "covered", "size"))],
                    ["doc_id", "n_words", "places", "spans"],
                )

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    labels = lambda *columns: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*columns))))
    covered = F.array_max(F.transform("spans", lambda s: F.least(F.lit(1.0), s["covered"] / s["size"])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.first").alias("first_word"), F.array_max("places.first").alias("last_word"),
        labels("places.label").alias("base_labels"), labels("places.label", "spans.label").alias("labels"),
        F.coalesce(covered, F.when(F.size("places") > 0, 0.5), F.lit(0.0)).alias("score"),
    )
