"""Benchmark items inside documents, up to a share of edits (operator 8).

An item of n characters may be found with up to ``n * EDIT_PERCENT / 100`` insertions, deletions and
replacements. It is split into one piece more than that: whatever the edits are, one piece is
untouched. An automaton of all pieces finds their exact hits in one pass over a text; hits of an item that
belong to the same place become one window, and Myers' bit-parallel algorithm gives the least distance in
the window, with a machine word of any length. Before that, windows are left out that have fewer of the item's
stretches of q characters than any match must have: an edit changes at most q of them.

Texts are compared in lower case with white space as single spaces. Items with fewer than ``LEAST_CHARS``
characters are not looked for: they are found in clean texts too.

Items go to the executors in blocks of at most ``BLOCK_CHARS`` characters; a larger benchmark takes more
passes over the documents. Documents are never shuffled, and a task holds one text at a time.

Defined results: null and empty texts and items match nothing. Repeated documents and repeated items
are found as often as they occur; null ids are kept as nulls. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqsieve.llm.stored import only

EDIT_PERCENT = 10
LEAST_CHARS = 20
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, percent: int) -> int:
    return n * percent // 100


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of about equal length, with their places."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """The least edit distance of a pattern to any part of a text."""

    def __init__(self, pattern: str):
        self.n, self.places = len(pattern), {}
        for i, c in enumerate(pattern):
            self.places[c] = self.places.get(c, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """Distance and end of the first best part, if the distance is at most ``most``."""
        full = (1 << self.n) - 1
        last, get = 1 << self.n - 1, self.places.get
        plus, minus, score, found = full, 0, self.n, None
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | ~(diagonal | plus) & full
            down = plus & diagonal
            if up & last:
                score += 1
            elif down & last:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(diagonal | up) & full
            minus = up & diagonal
            if score <= most:
                found, most = (score, at), score - 1
        return found


class Finder:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]], percent: int):
        self.items = [(i, text, budget(len(text), percent)) for i, text in items]
        self.q = max(2, 50 // max(1, percent))
        self.stretches: dict[int, frozenset[str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.matchers: dict[int, tuple[Myers, Myers]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for nr, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                places.setdefault(piece, []).append((nr, at))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def _may_match(self, nr: int, window: str) -> bool:
        """Whether the window has enough of the item's stretches."""
        q, (_, text, errors) = self.q, self.items[nr]
        if nr not in self.stretches:
            self.stretches[nr] = frozenset(text[i: i + q] for i in range(len(text) - q + 1))
        asked = len(self.stretches[nr]) - q * errors
        return asked <= 0 or len(self.stretches[nr].intersection([window[i: i + q] for i in range(len(window) - q + 1)])) >= asked

    def _windows(self, nr: int, starts: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Stretches of the text that hold every match whose untouched piece puts its start at one of these places."""
        _, text, errors = self.items[nr]
        begin = end = None
        for start in sorted(set(starts)):
            a, b = max(0, start - errors), min(size, start + len(text) + errors)
            if begin is not None and start - errors <= last + errors:
                end, last = b, start
                continue
            if begin is not None:
                yield begin, end
            begin, end, last = a, b, start
        if begin is not None:
            yield begin, end

    def find(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """Item id, distance, start and end in the normal text: the best match of every item that is found."""
        if not self.items:
            return
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for nr, at in where:
                starts.setdefault(nr, []).append(end - size + 1 - at)
        for nr in sorted(starts):
            item, pattern, errors = self.items[nr]
            if nr not in self.matchers:
                self.matchers[nr] = Myers(pattern), Myers(pattern[::-1])
            forward, backward = self.matchers[nr]
            best = None
            for a, b in self._windows(nr, starts[nr], len(text)):
                if not self._may_match(nr, text[a:b]):
                    continue
                met = forward.best(text[a:b], errors if best is None else best[0] - 1)
                if met:
                    best = met[0], a + met[1]
            if best:
                distance, end = best
                head = text[max(0, end - len(pattern) - errors): end][::-1]
                yield item, distance, end - backward.best(head, distance)[1], end


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int, least: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in normal form, in blocks of bounded size; the driver holds one block at a time."""
    held, size = [], 0
    rows = only(benchmark, item_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text)
        if len(text) < least:
            continue
        held.append((row.item_id, text))
        size += len(text)
        if size >= block_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", percent: int = EDIT_PERCENT, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, start, stop``: each item in each document that has it, at its best place."""
    schema = "doc_id long, item_id long, distance int, start long, stop long"
    names = [c.split()[0] for c in schema.split(", ")]
    texts = only(docs, doc_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    context, found = docs.sparkSession.sparkContext, None
    for block in blocks(benchmark, item_col, item_text, block_chars, least):
        shared = context.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, percent)
            for batch in batches:
                made = [(doc_id.as_py(), *m) for doc_id, text in zip(*batch.columns) for m in finder.find(normal(text.as_py()))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                columns = list(zip(*made)) or [[]] * 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        part = texts.mapInArrow(rows, schema)
        found = part if found is None else found.union(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  percent: int = EDIT_PERCENT, least: int = LEAST_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents in which no item is found, as they are."""
    context, place = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text, block_chars, least):
        shared = context.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(shared.value, percent)
            for batch in batches:
                clean = [next(finder.find(normal(text.as_py())), None) is None for text in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
