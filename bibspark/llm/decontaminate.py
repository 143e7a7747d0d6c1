"""Benchmark decontamination by pigeonhole edit matching over words.

An item with an error budget of e words is cut into e + 1 pieces: a passage within e word
edits of the item contains a piece unchanged. Pieces are found by one Aho-Corasick automaton;
around each hit Myers' bit-parallel algorithm measures the edit distance.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import schema_with

WORD = re.compile(r"[^\W_]+")
#: Scripts without spaces (Thai, Lao, Burmese, Khmer, kana, Han): each character is a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\U00020000-\U0003ffff]")
#: Errors allowed for each word of an item; an item of under five words must stand unchanged.
RATE = 0.2
#: Items go to the tasks in blocks of so many characters, whatever the benchmark's size.
BLOCK_CHARS = 32 << 20


def normal(text: str | None) -> list[str]:
    """Letters and digits as words, lower case, in compatibility form; unspaced scripts by character."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = UNSPACED.sub(r" \g<0> ", text)
    return WORD.findall(text.lower())


def nearest(item: list[str], text: list[str]) -> tuple[int, int]:
    """Least word edit distance of the item to a passage of the text, and the passage's end."""
    m = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(item):
        peq[w] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """The pieces of a block of items as one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items: list[tuple[int, list[str], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            words = normal(text)
            if not words:
                continue
            budget = int(rate * len(words))
            at = len(self.items)
            self.items.append((key, words, budget))
            for i in range(budget + 1):
                a, b = i * len(words) // (budget + 1), (i + 1) * len(words) // (budget + 1)
                pieces[" " + " ".join(words[a:b]) + " "].append((at, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, words of the item, end in words) of every item within its budget."""
        words = normal(text)
        if not self.items or not words:
            return []
        joined = " " + " ".join(words) + " "
        hits = list(self.automaton.iter(joined))
        if not hits:
            return []
        at = np.cumsum([0] + [len(w) + 1 for w in words])  # where each word's leading space is
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (length, owners) in hits:
            word = int(np.searchsorted(at, end - length + 1))
            for i, offset in owners:
                _, item, budget = self.items[i]
                spans[i].append((max(0, word - offset - budget), min(len(words), word - offset + len(item) + budget)))
        found = []
        for i, places in spans.items():
            key, item, budget = self.items[i]
            best, a, b = (budget + 1, 0), *min(places)
            for c, d in [*sorted(places), (len(words) + 1, 0)]:
                if c <= b:
                    b = max(b, d)
                    continue
                distance, end = nearest(item, words[a:b])
                best = min(best, (distance, a + end))
                a, b = c, d
            if best[0] <= budget:
                found.append((key, best[0], len(item), best[1]))
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters."""
    key = F.col("item_id").cast("long" if benchmark.schema["item_id"].dataType.typeName() in ("byte", "short", "integer", "long") else "string")
    items = benchmark.select(key.alias("item_id"), "text").dropna()
    n = 1 + (items.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    for i in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()]


def _matcher(documents: DataFrame, items: list[tuple[int, str]], rate: float) -> Callable[[], Matcher]:
    shared = documents.sparkSession.sparkContext.broadcast(items)  # BLOCK_CHARS, about
    return lambda: Matcher(shared.value, rate)


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, item_words and end_word for each item that a text contains.

    Whole texts are searched, row by row, with no shuffle. Items with null id or text and items
    without words match nothing, items of under five words match unchanged only, null and empty
    texts contain nothing, of items with the same id each is searched and the rows may repeat,
    repeated documents give repeated rows, and other columns are ignored. Empty tables give no
    rows. ``item_id`` is a long if it is a whole number, else a string.
    """
    whole = benchmark.schema["item_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    schema = schema_with(documents.select("doc_id"), f"item_id {'long' if whole else 'string'}, distance int, item_words int, end_word int")
    out = None
    for items in _blocks(benchmark):
        make = _matcher(documents, items, rate)

        def run(batches: Iterator[pa.RecordBatch], make: Callable[[], Matcher] = make) -> Iterator[pa.RecordBatch]:
            matcher = make()
            for batch in batches:
                rows = [(i, *m) for i, t in enumerate(batch.column(1)) for m in matcher.matches(t.as_py())]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64() if whole else pa.string(), pa.int32(), pa.int32(), pa.int32())
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True))],
                    names=["doc_id", "item_id", "distance", "item_words", "end_word"],
                )

        part = documents.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def cleaned(documents: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that contain no item; rows are judged where they are, with no shuffle.

    Columns stay, whatever their names; null and empty texts contain nothing and stay, repeated
    rows are judged alike, and an empty table or benchmark changes nothing. Items are those of
    contaminated().
    """
    at = documents.columns.index("text")
    for items in _blocks(benchmark):
        make = _matcher(documents, items, rate)

        def run(batches: Iterator[pa.RecordBatch], make: Callable[[], Matcher] = make) -> Iterator[pa.RecordBatch]:
            matcher = make()
            for batch in batches:
                yield batch.filter(pa.array([not matcher.matches(t.as_py()) for t in batch.column(at)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
