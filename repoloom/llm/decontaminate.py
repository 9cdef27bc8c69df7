"""Benchmark decontamination: training words stream through a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, keyed, stored, texts_of

WINDOW = 10
AUTOMATON_WORDS = 200_000
SEGMENT_WORDS = 20_000
COVERAGE = 0.5
# A-Z to lower case; all that is neither a digit nor a letter nor beyond ASCII to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences.

    States are classes of substrings with the same ends; `link` leads to the
    longest suffix that is another class.  For each state, `owners` has the
    items with the window of its strings' last words, `shorts` the items of
    fewer words that end where its strings end.
    """

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int = WINDOW):
        """items: (id, words, whole): `whole` if a sequence of fewer words than a window counts as one."""
        self.window = window
        self.size, self.link, self.next = [0], [-1], [{}]
        self.vocabulary: dict[bytes, int] = {}
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], whole) for key, words, whole in items if words]
        for _, codes, _ in coded:
            self._insert(codes)
        self.top = [0] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up = self.link[state]
            self.top[state] = state if self.size[up] < window <= self.size[state] else self.top[up]
        self.owners: dict[int, set] = {}
        ends: dict[int, list] = {}
        for key, codes, whole in coded:
            state = 0
            for at, code in enumerate(codes):
                state = self.next[state][code]
                if at + 1 >= window:
                    self.owners.setdefault(self.top[state], set()).add(key)
            if whole and len(codes) < window:
                ends.setdefault(state, []).append((len(codes), key))
        self.shorts: dict[int, list] = {}
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__) if ends else []:
            found = self.shorts.get(self.link[state], []) + ends.get(state, [])
            if found:
                self.shorts[state] = found
        pairs = {a * len(self.vocabulary) + b for _, codes, _ in coded for a, b in zip(codes, codes[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *(len(codes) for _, codes, whole in coded if whole and len(codes) < window)])

    def _new(self, size: int, link: int, edges: dict) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(edges)
        return len(self.size) - 1

    def _split(self, state: int, code: int, target: int) -> int:
        """The class of the shorter strings of `target`, those that end with `state` and code."""
        clone = self._new(self.size[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = clone
            state = self.link[state]
        return clone

    def _insert(self, codes: list[int]) -> None:
        last = 0
        for code in codes:
            target = self.next[last].get(code)
            if target is not None:
                last = target if self.size[target] == self.size[last] + 1 else self._split(last, code, target)
                continue
            fresh, state = self._new(self.size[last] + 1, 0, {}), last
            while state >= 0 and code not in self.next[state]:
                self.next[state][code] = fresh
                state = self.link[state]
            if state >= 0:
                target = self.next[state][code]
                self.link[fresh] = target if self.size[target] == self.size[state] + 1 else self._split(state, code, target)
            last = fresh

    def runs(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Codes of the words, and the stretches in which every pair of neighbours stands in some item."""
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = codes >= 0
        if not known.any():
            return codes, []
        pair = codes[:-1] * len(self.vocabulary) + codes[1:]
        if len(self.pairs):
            at = np.searchsorted(self.pairs, pair)
            joined = (self.pairs[np.minimum(at, len(self.pairs) - 1)] == pair) & known[:-1] & known[1:]
        else:
            joined = np.zeros(len(pair), bool)
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined)))
        ends = np.flatnonzero(known & ~np.concatenate((joined, [False]))) + 1
        long = ends - starts >= self.least
        return codes, list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans (first, end) of words hit by a window, ascending and apart, and the items whose windows occur."""
        spans: list[list[int]] = []
        items: set = set()
        codes, runs = self.runs(words)
        size, link, edges, window = self.size, self.link, self.next, self.window
        for start, end in runs:
            state = length = 0
            for at, code in enumerate(codes[start:end].tolist(), start):
                while state and code not in edges[state]:
                    state = link[state]
                    length = size[state]
                state = edges[state].get(code, 0)
                length = length + 1 if state else 0
                hit = 0
                if length >= window:
                    hit = window
                    items |= self.owners[self.top[state]]
                for n, key in self.shorts.get(state, ()):
                    if n <= length:
                        hit = max(hit, n)
                        items.add(key)
                if hit:
                    first = at + 1 - hit
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append([first, at + 1])
        return [(a, b) for a, b in spans], items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automata(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = AUTOMATON_WORDS) -> list:
    """Functions that each give the automaton of a share of the items, of about `most` words.

    Items are normalised in tasks; one of over 20,000 words is cut into
    segments that overlap by a window less one word.  Only one share is on the
    driver at a time, and none is larger than twice the documented bound.
    """
    rows = keyed(items.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.lit(""))), id_col, text_col)

    def segments(batches):
        for batch in batches:
            out = []
            for key, text in texts_of([batch]):
                words = words_of(text)
                step = SEGMENT_WORDS - window + 1
                for at in range(0, max(1, len(words) - window + 1), step) if words else ():
                    part = words[at:at + SEGMENT_WORDS]
                    out.append((key, b" ".join(part).decode(), len(part), len(words) < window))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)],
                                             names=["id", "words", "n", "whole"])

    cut = stored(rows.mapInArrow(segments, "id string, words string, n long, whole boolean"))
    shares = max(1, -(-(cut.agg(F.sum("n")).first()[0] or 0) // most))
    share = F.pmod(F.xxhash64("id", "words"), F.lit(shares))

    def built(k: int):
        def make() -> Automaton:
            got = cut.where(share == k).orderBy("id", "words").collect()
            return Automaton([(r.id, r.words.encode().split(), r.whole) for r in got], window)
        return make

    return [built(k) for k in range(shares)]


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, cut: bool = False) -> DataFrame:
    """(id, n_words, spans, items, text) for every row of docs, without a shuffle.

    spans: array of (first, end) word positions, merged, of the words inside
    any occurrence of a window; items: the ids of items with an occurring
    window.  A window is `window` consecutive words of an item, or all words
    of a shorter one.  Null and empty texts and items have no words; repeated
    rows count each time; an empty table of items hits nothing.
    """
    rows = keyed(docs, id_col, text_col).withColumns({"spans": F.lit(None).cast("array<array<long>>"), "items": F.lit(None).cast("array<string>")})
    ddl = f"id {id_type(rows)}, text string, spans array<array<long>>, items array<string>, n_words long"
    shares = automata(items, item_col, item_text, window, automaton_words)
    for n, make in enumerate(shares):
        shipped = docs.sparkSession.sparkContext.broadcast(make())

        def matched(batches, shipped=shipped, last=n + 1 == len(shares)):
            automaton = shipped.value
            for batch in batches:
                spans, names, counts, texts = [], [], [], []
                for text, old, had in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = words_of(text)
                    new, found = automaton.matches(words)
                    spans.append([list(s) for s in (_merged([*map(tuple, old), *new]) if old else new)])
                    names.append(sorted(found | set(had or ())))
                    counts.append(len(words))
                    texts.append(text if not last else without_spans(text, spans[-1]) if cut and spans[-1] else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string())), pa.array(counts, pa.int64())],
                    names=["id", "text", "spans", "items", "n_words"])

        rows = rows.select("id", "text", "spans", "items").mapInArrow(matched, ddl)
        if n + 1 < len(shares):
            rows = stored(rows)
    return rows


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of find_contamination()."""
    found = find_contamination(docs, items, **options)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        F.col("id").alias(options.get("id_col", "doc_id")), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_spans(text: str, spans: list) -> str:
    """The text without the characters from the first to the last word of each span."""
    out, at = [], 0
    bounds = iter([m.span() for m in _WORD.finditer(text)])
    place = 0
    for first, end in spans:
        for place in range(place, first + 1):
            start, _ = bound = next(bounds)
        for place in range(first + 1, end):
            bound = next(bounds)
        place = end
        out.append(text[at:start])
        at = bound[1]
    out.append(text[at:])
    return "".join(out)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE, **options) -> DataFrame:
    """docs without test passages: the hit spans are cut out of the texts; documents hit in over `coverage` of their words go.

    Other documents keep text and columns as they are; a null text stays
    null.  n_chars, where docs has it, is that of the new text.
    """
    carried = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(F.struct(*[F.col(c) for c in [id_col, text_col, *carried]]).alias("row"), F.col(text_col).alias("text"))
    # the row travels as the id, so that nothing has to be joined back
    found = find_contamination(packed, items, id_col="row", text_col="text", cut=True, **options)

    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    kept = found.where(hit <= F.col("n_words") * coverage)
    out = kept.withColumn("new_text", F.coalesce("text", F.col(f"id.{text_col}")))
    columns = {c: F.col(f"id.{c}") for c in docs.columns} | {text_col: F.col("new_text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.size("spans") > 0, F.char_length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("id.n_chars"))
    return out.select(*[v.alias(k) for k, v in columns.items()])
