"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ by k = m * ``ERROR_RATE`` edits. Cut into k + 1 pieces, at least one piece of an
item that occurs with at most k edits is in the text unchanged. All pieces of a block of items are looked for in one pass
over the whole text, and each hit is verified with Myers' bit-parallel distance on the text around it. Items under
``SHORT`` characters have to occur without any edit and as whole words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pliego.llm.common import slices
from pliego.session import kept, shared_folder

ERROR_RATE = 0.05
SHORT = 32  # characters; with edits or within words shorter items would be found by chance
ITEMS_PER_PASS = 20_000

# Characters that belong to one word with their neighbours; scripts without spaces between words have none.
JOINED = re.compile(r"[^\W\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

MATCHES = "doc_id bigint, item_id bigint, distance int, match_end bigint"


def normalised(text: str | None) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join((text or "").lower().split())


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces that differ in length by one at most, with their offsets."""
    n = errors + 1
    edges = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def masks(item: str) -> dict[str, int]:
    """By character, the bits of its places in the item."""
    bits: dict[str, int] = {}
    for i, ch in enumerate(item):
        bits[ch] = bits.get(ch, 0) | 1 << i
    return bits


def closest(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance between the item and any substring of ``text``, and the first end where it is reached.

    Myers' vertical differences, one machine-independent integer for all m rows.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, ch in enumerate(text, 1):
        same = bits.get(ch, 0)
        across = (((same & plus) + plus) ^ plus) | same | minus
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        vertical = same | minus
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, at
    return best, end


def whole_words(text: str, begin: int, end: int) -> bool:
    """Whether neither end of a place in the text cuts a word."""
    return not any(0 < at < len(text) and JOINED.match(text[at - 1]) and JOINED.match(text[at]) for at in (begin, end))


class Matcher:
    """Finds every item of a block in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate) if len(t) >= SHORT else 0) for i, t in items]
        self.bits: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in cut(text, errors):
                found.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of each item found, at its closest place tested."""
        if not len(self.automaton):
            return []
        best: dict[int, tuple[int, int]] = {}
        tested: dict[int, set[int]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                if best.get(n, (1,))[0] == 0:
                    continue
                begin = last - size + 1 - offset  # of the item, if nothing was inserted or lost before the piece
                if begin in tested.setdefault(n, set()):
                    continue
                tested[n].add(begin)
                item_id, item, errors = self.items[n]
                if len(item) < SHORT and not whole_words(text, begin, begin + len(item)):
                    continue
                if text.startswith(item, max(begin, 0)):
                    best[n] = (0, max(begin, 0) + len(item))
                    continue
                if not errors:
                    continue
                if n not in self.bits:
                    self.bits[n] = masks(item)
                low = max(0, begin - errors)
                distance, end = closest(self.bits[n], len(item), text[low : begin + len(item) + errors])
                if distance <= errors and distance < best.get(n, (errors + 1,))[0]:
                    best[n] = (distance, low + end)
        return [(self.items[n][0], d, end) for n, (d, end) in best.items()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, distance, match_end (in the normalised text).

    Null and blank texts and items match nothing; items under ``SHORT`` characters match as whole words without edits;
    items that are equal after normalising are all reported; repeated documents are reported once; documents and items
    without id are left out here (see ``clean``). Of places with equal distances one is reported. A very long text is read
    whole, by one task that holds it in memory. Extra columns are ignored; an empty table on either side gives no rows.
    Items travel to the tasks in passes of about ``ITEMS_PER_PASS``, each one scan of the documents.
    """
    return _matches(docs, benchmark.filter("item_id is not null"), rate)


def _matches(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    passes = -(-benchmark.count() // ITEMS_PER_PASS)
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "matches")
    if not passes:
        return spark.createDataFrame([], MATCHES)
    for n in range(passes):  # each is written before the next one's items come to the driver
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        mine = part.select("item_id", "text").distinct().collect()
        items = {(r.item_id, normalised(r.text)) for r in mine}
        found = _scan(docs, sorted((x for x in items if x[1]), key=lambda x: (x[0] is not None, x)), rate)
        found.write.mode("append").parquet(folder)
    return spark.read.schema(MATCHES).parquet(folder).groupBy("doc_id", "item_id").agg(
        F.min(F.struct("distance", "match_end")).alias("at")
    ).select("doc_id", "item_id", "at.distance", "at.match_end")


def _scan(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Matcher(items, rate)
        for batch in slices(batches, "text"):
            rows = [
                (doc_id, *hit)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for hit in find(normalised(text))
            ]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "item_id", "distance", "match_end"],
            )

    known = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, MATCHES)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no test item was found, with an id or without; rows without doc_id or text stay; columns
    unchanged."""
    leaked = kept(_matches(docs, benchmark, rate).select(F.col("doc_id").alias("_leaked")).distinct(), "leaked")
    return docs.join(leaked, docs["doc_id"] == leaked["_leaked"], "left_anti")
