"""Splitting pages into overlapping chunks. Narrow: a page becomes an array of pieces in its own row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pliego import constants as K

SEPARATORS = ["\n\n", "\n", " ", ""]


def piece_count(size: Column, chunk: Column, overlap: Column) -> Column:
    """Pieces of a text of ``size`` characters."""
    return F.greatest(F.lit(0), F.ceil((size - chunk) / (chunk - overlap))).cast("bigint") + 1


def piece_chars(size: Column, chunk: Column, overlap: Column) -> Column:
    """Characters in all pieces together: every piece but the first repeats ``overlap`` characters."""
    return size + (piece_count(size, chunk, overlap) - 1) * overlap


def fixed_pieces(text: Column, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` characters that start every ``size - overlap`` characters."""
    last = piece_count(F.length(text), F.lit(size), F.lit(overlap)) - 1
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")), lambda i: F.substring(text, i * (size - overlap) + 1, F.lit(size))
    )


def chunk_fixed(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk with ``pos`` in its page; all page columns are inherited."""
    kept = [c for c in pages.columns if c != "page_content"]
    return pages.select(*kept, F.posexplode(fixed_pieces(F.col("page_content"), size, overlap)).alias("pos", "page_content"))


def sweep(pages: DataFrame, settings: list[tuple[int, int]]) -> DataFrame:
    """Chunks and characters per (size, overlap). Only text lengths are needed, so no piece is built."""
    options = F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in settings])
    each = pages.select(F.length("page_content").cast("bigint").alias("n"), F.explode(options).alias("o"))
    size, overlap = F.col("o.size"), F.col("o.overlap")
    return each.groupBy(size.alias("chunk_size"), overlap.alias("chunk_overlap")).agg(
        F.sum(piece_count(F.col("n"), size, overlap)).alias("chunks"),
        F.sum(piece_chars(F.col("n"), size, overlap)).alias("chars"),
    )


def _atoms(text: str, size: int, level: int = 0) -> Iterator[str]:
    """Cut at the first separator that occurs (it stays at the head of the next part); cut longer parts again."""
    while level < len(SEPARATORS) - 1 and SEPARATORS[level] not in text:
        level += 1
    mark = SEPARATORS[level]
    if not mark:
        yield from text
        return
    head, *others = text.split(mark)
    for part in filter(None, [head, *(mark + o for o in others)]):
        if len(part) <= size:
            yield part
        else:
            yield from _atoms(part, size, level + 1)


def _pack(text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, chunk): fill up to ``size``, then go on from the longest tail of whole parts within ``overlap`` that leaves
    room for the next part and begins, white space aside, after the last chunk's start. So no chunk contains the one before it;
    a chunk that would end where an earlier one does holds nothing new and is left out."""
    begin = end = 0
    last = stop = -1
    cuts: list[int] = []

    def filled() -> Iterator[tuple[int, str]]:
        nonlocal last, stop
        start = _first(text, begin, end)
        body = text[start:end].rstrip()
        if body and start + len(body) > stop:
            last, stop = start, start + len(body)
            yield start, body

    for part in _atoms(text, size):
        if end - begin + len(part) > size:
            yield from filled()
            fits = (c for c in cuts if end - c <= overlap and end - c + len(part) <= size)
            begin = next((c for c in fits if _first(text, c, end) > last), end)
            cuts = [c for c in cuts if c >= begin]
        cuts.append(end)
        end += len(part)
    yield from filled()


def _first(text: str, begin: int, end: int) -> int:
    """Where the first character that is no white space is, or the end."""
    return end - len(text[begin:end].lstrip())


ROWS = 64  # pages whose pieces are held as Python values at a time


def _pieces(texts: list[str | None], size: int, overlap: int) -> pa.ListArray:
    starts, parts, ends = [], [], [0]
    for text in texts:
        for start, part in _pack(text or "", size, overlap):
            starts.append(start)
            parts.append(part)
        ends.append(len(starts))
    fields = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(parts, pa.string())], names=["start", "text"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


def split_recursive(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Add ``pieces``, an array of (start, text) cut at paragraph, line, word or character."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the chunk size")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                yield some.append_column("pieces", _pieces(some.column("page_content").to_pylist(), size, overlap))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pages.schema)}, pieces array<struct<start:int,text:string>>"
    return pages.mapInArrow(cut, schema)


def chunk_recursive(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    kept = [c for c in pages.columns if c != "page_content"]
    return (
        split_recursive(pages, size, overlap)
        .select(*kept, F.posexplode("pieces").alias("pos", "piece"))
        .select(*kept, "pos", F.col("piece.start").alias("start"), F.col("piece.text").alias("page_content"))
    )


def _unfilled(text: Column, firsts: Column, size: int) -> Column:
    """How many of the chunks ``firsts`` (start, text), each followed by another one, had room for the part after them.

    That is the part that holds the next character that is no white space: its paragraph, line or word, the first of them
    that is no longer than ``size``, or the character. Only the ``size`` characters around it are looked at; a part that
    they do not hold would not have fitted. Every step is bound once, so that no text is cut twice.
    """
    width = size + 2
    blanks = F.lit(K.PYTHON_BLANKS)

    def place(a: Column) -> Column:
        lead = F.substring(text, F.greatest(a["start"] - size, F.lit(0)) + 1, F.least(a["start"], F.lit(size)))
        stop = a["start"] + F.length(a["text"])
        rest = F.substring(text, stop + 1, F.lit(width))
        begin = a["start"] - F.length(lead) + F.length(F.rtrim(lead, blanks))
        return F.struct(begin.alias("begin"), (stop + F.length(rest) - F.length(F.ltrim(rest, blanks))).alias("at"))

    def around(p: Column) -> Column:
        at = p["at"]
        before = F.substring(text, F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width)))
        return F.struct(p["begin"].alias("begin"), at.alias("at"), before.alias("before"), F.substring(text, at + 1, F.lit(width)).alias("after"))

    def parts(p: Column) -> Column:
        before, after = p["before"], p["after"]
        tail = F.length(F.substring_index(before, "\n\n", -1))
        return F.struct(
            *[p[c].alias(c) for c in ("begin", "at")],
            tail.alias("tail"),
            F.substring(before, F.lit(1), F.length(before) - tail).alias("run"),
            F.length(F.substring_index(after, "\n\n", 1)).alias("paragraph"),
            F.substring_index(before, "\n", -1).alias("line_tail"),
            before.contains("\n").cast("int").alias("line_mark"),
            F.substring_index(after, "\n", 1).alias("line"),
        )

    def room(p: Column) -> Column:
        newlines = F.length(p["run"]) - F.length(F.rtrim(p["run"], F.lit("\n")))
        # line ends are taken in pairs from the first on, so an odd one more belongs to the paragraph after it
        mark = F.when(newlines == 0, F.lit(0)).otherwise(2 + newlines % 2)
        unknown = (newlines > 0) & (newlines == F.length(p["run"])) & (p["at"] > width)
        line_tail, line = p["line_tail"], F.length(p["line"])
        word = F.length(F.substring_index(p["line"], " ", 1))
        word_mark = F.when(line_tail.contains(" "), F.lit(1)).otherwise(p["line_mark"])
        part = (
            F.when(unknown, F.lit(size + 1))
            .when(mark + p["tail"] + p["paragraph"] <= size, p["paragraph"])
            .when(p["line_mark"] + F.length(line_tail) + line <= size, line)
            .when(word_mark + F.length(F.substring_index(line_tail, " ", -1)) + word <= size, word)
            .otherwise(F.lit(1))
        )
        return p["at"] + part - p["begin"] <= size

    near = F.filter(F.transform(firsts, place), lambda p: (p["at"] < F.length(text)) & (p["at"] - p["begin"] < size))
    return F.size(F.filter(F.transform(F.transform(near, around), parts), room))


def invariant_violations(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Counts per broken promise of the recursive splitter; every count has to be 0."""
    split = split_recursive(pages, size, overlap)
    text, pieces = F.col("page_content"), F.col("pieces")

    def stop(p: Column) -> Column:
        return p["start"] + F.length(p["text"])

    def between(begin: Column, end: Column) -> Column:
        return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))

    gaps = F.transform(
        F.sequence(F.lit(0), F.size(pieces)),
        lambda i: between(
            F.when(i > 0, stop(F.get(pieces, i - 1))).otherwise(F.lit(0)),
            F.when(i < F.size(pieces), F.get(pieces, i)["start"]).otherwise(F.length(text)),
        ),
    )

    def broken(test) -> Column:
        return F.size(F.filter(pieces, test))

    def pairs(test) -> Column:
        """How many neighbouring pieces fail a test."""
        first, second = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), F.slice(pieces, 2, F.size(pieces))
        return F.size(F.filter(F.zip_with(first, second, test), lambda x: x))

    counted = split.select(
        broken(lambda p: (F.length(p["text"]) < 1) | (F.length(p["text"]) > size)).alias("bad_length"),
        broken(lambda p: F.substring(text, p["start"] + 1, F.length(p["text"])) != p["text"]).alias("not_in_page"),
        F.size(F.filter(gaps, lambda g: F.btrim(g, F.lit(K.PYTHON_BLANKS)) != "")).alias("uncovered"),
        pairs(lambda a, b: stop(a) - b["start"] > overlap).alias("too_much_overlap"),
        pairs(lambda a, b: b["start"] <= a["start"]).alias("not_in_order"),
        _unfilled(text, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), size).alias("not_filled"),
    )
    return counted.agg(*[F.coalesce(F.sum(c).cast("bigint"), F.lit(0)).alias(c) for c in counted.columns])
