"""Removal of repeated byte strings, by suffix sorting of what can repeat at all.

Each window of ``WINDOW`` bytes has an anchor, the smallest hash of the ``SHINGLE``-byte strings in it. Equal windows have
equal anchors, so a window can only repeat if its anchor does. Neighbouring windows with one anchor are a context, the string
they cover together. The job has five steps:

1. Anchors of all documents, each once per task, are shuffled by anchor; those met once in all are dropped.
2. The contexts of the other anchors are cut from the texts. Of equal contexts of a task only the first goes on, the others
   are covered as a whole.
3. Contexts meet by anchor. Of equal ones only the first goes on. Distinct contexts of an anchor are suffix sorted (see
   ``suffixes``), and adjacent suffixes that share ``WINDOW`` bytes are repeats.
4. An anchor with more contexts than one task should hold goes another way: its contexts are cut into single windows, and equal
   windows are aggregated.
5. Covered stretches meet their document, which is digested.

Texts are compressed where they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pliego.llm.common import slices
from pliego.llm.near import mixed
from pliego.llm.suffixes import equal_windows
from pliego.session import kept

WINDOW = 100
SHINGLE = 32
LONGEST = 4_096  # windows per context at most; longer ones are cut
CROWD = 2_000  # contexts of one anchor that are sorted in one task
BLOCK = 1 << 21  # bytes per suffix array
HELD = 32 << 20  # bytes of contexts held per task while equal ones are looked for
PLACE = np.uint64(127)  # low bits of an anchor say where it is, relative to the window


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor at one place: anchor, first window, window after the last one, and whether the
    run's windows hold the anchor at a later place as well, so that they can be equal among themselves."""
    nothing = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return nothing, nothing, nothing, nothing > 0
    part = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    factor, size = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < SHINGLE:  # hash of twice the length from two halves
            part = part[:-size] * factor + part[size:]
            part = part ^ (part >> np.uint64(32))
            factor, size = factor * factor, 2 * size
        hashes = mixed(part) & ~PLACE
    least = hashes | (np.arange(part.size, dtype=np.uint64) & PLACE)
    reach, width = 1, WINDOW - SHINGLE + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    chosen = least[begin]
    place = begin + (((chosen & PLACE).astype(np.int64) - begin) & int(PLACE))
    after = np.append(begin[1:], least.size)
    follow = np.lib.stride_tricks.sliding_window_view(np.append(hashes, np.zeros(width, np.uint64)), width)[place, 1:]
    inside = place[:, None] + np.arange(1, width) < (after + width - 1)[:, None]
    again = ((follow == (chosen & ~PLACE)[:, None]) & inside).any(1)
    return (chosen >> np.uint64(7)).astype(np.int64), begin, after, again


def contexts(data: bytes, wanted: np.ndarray) -> Iterator[tuple[int, int, int, bool]]:
    """(anchor, begin, end, may repeat in itself) of the contexts of the wanted (sorted) anchors."""
    anchor, first, after, again = anchors(data)
    at = np.minimum(np.searchsorted(wanted, anchor), wanted.size - 1)
    some = wanted[at] == anchor
    anchor, first, after, again = anchor[some], first[some], after[some], again[some]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != after[:-1]))[: anchor.size]
    begin = np.flatnonzero(new)
    if not begin.size:
        return
    runs = np.diff(np.append(begin, anchor.size))
    own = (runs > 1) | np.logical_or.reduceat(again, begin)
    for a, b, e, o in zip(anchor[begin].tolist(), first[begin].tolist(), after[begin + runs - 1].tolist(), own.tolist()):
        for cut in range(b, e, LONGEST):
            yield a, cut, min(cut + LONGEST, e) + WINDOW - 1, o


def _packed(docs: DataFrame) -> DataFrame:
    """doc and the compressed UTF-8 bytes of its text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "data"):
            yield pa.record_batch(
                [batch.column("doc"), pa.array([squeeze(x) for x in batch.column("data").to_pylist()], pa.binary())], names=["doc", "packed"]
            )

    return docs.mapInArrow(pack, "doc bigint, packed binary")


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed) if packed else b""


def _batch(rows: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in rows.values()], names=list(rows))


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(doc, anchor) of the anchors that are met more than once in all documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, owners, held = [], [], 0

        def table() -> pa.RecordBatch:
            anchor = np.concatenate(found)
            doc = np.repeat(np.array([d for d, _ in owners], np.int64), [n for _, n in owners])
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            new = np.append(True, anchor[1:] != anchor[:-1])[: anchor.size]
            many = ~new | np.append(~new[1:], False)[: anchor.size]
            fresh = new | np.append(False, doc[1:] != doc[:-1])[: anchor.size]  # each document once per anchor
            # once in this task: goes to its anchor; several times: known to repeat, and announced to the others
            announced = many & new
            known = many & fresh
            single = ~many
            parts = [(single, 1), (announced, 2), (known, 0)]
            weight = np.concatenate([np.full(int(p.sum()), w, np.int32) for p, w in parts])
            anchors_, docs_ = (np.concatenate([c[p] for p, _ in parts]) for c in (anchor, doc))
            spread = np.where(weight > 0, anchors_, docs_ * 2654435761 + anchors_)
            return pa.record_batch([pa.array(c) for c in (spread, anchors_, docs_, weight)], names=["spread", "anchor", "doc", "weight"])

        for batch in slices(batches, "data"):
            for doc, data in zip(batch.column("doc").to_pylist(), batch.column("data").to_pylist()):
                anchor, _, _, again = anchors(data)
                found += [anchor, anchor[again]]
                owners.append((doc, anchor.size + int(again.sum())))
                held += anchor.size
            if held > 4_000_000:
                yield table()
                found, owners, held = [], [], 0
        if found:
            yield table()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            anchor, doc, weight = (batch.column(c).to_numpy() for c in ("anchor", "doc", "weight"))
            direct = weight == 0
            if direct.any():
                yield pa.record_batch([pa.array(doc[direct]), pa.array(anchor[direct])], names=["doc", "anchor"])
            mine = [c[~direct] for c in (anchor, doc, weight)]
            if rest is not None:
                mine = [np.concatenate(c) for c in zip(rest, mine)]
            if not mine[0].size:
                continue
            last = np.searchsorted(mine[0], mine[0][-1])
            rest = [c[last:] for c in mine]
            yield judged(*[c[:last] for c in mine])
        if rest is not None:
            yield judged(*rest)

    def judged(anchor: np.ndarray, doc: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: anchor.size])
        total = np.add.reduceat(weight, begin) if begin.size else weight
        good = (np.repeat(total, np.diff(np.append(begin, anchor.size))) > 1) & (weight == 1)
        return pa.record_batch([pa.array(doc[good]), pa.array(anchor[good])], names=["doc", "anchor"])

    rows = docs.mapInArrow(scan, "spread bigint, anchor bigint, doc bigint, weight int")
    ordered = rows.repartition("spread").sortWithinPartitions("anchor").drop("spread")
    return ordered.mapInArrow(several, "doc bigint, anchor bigint")


CONTEXTS = "anchor bigint, doc bigint, begin bigint, end bigint, own boolean, string binary"


def _cut(packed: DataFrame, repeated: DataFrame) -> DataFrame:
    """Contexts of repeated anchors; those equal to an earlier one of the task come without anchor and string."""
    by_doc = repeated.groupBy("doc").agg(F.sort_array(F.collect_set("anchor")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[tuple[int, bool, bytes], tuple[int, int]] = {}
        held = 0

        def rows(items: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*items)) if items else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "doc", "begin", "end", "own", "string"])

        def firsts() -> pa.RecordBatch:
            return rows([(a, d, b, b + len(s), o, s) for (a, o, s), (d, b) in first.items()])

        for batch in slices(batches, "packed", 1 << 20):
            covered: list[list] = []  # stretches of neighbouring contexts are one row
            for doc, packed_, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "wanted"))):
                data = _unpack(packed_)
                for anchor, begin, end, own in contexts(data, np.array(wanted, np.int64)):
                    key, here = (anchor, own, data[begin:end]), (doc, begin)
                    there = first.setdefault(key, here)
                    if there is here:
                        held += end - begin
                        continue
                    if here < there:
                        first[key], here = here, there
                    until = here[1] + end - begin
                    if covered and covered[-1][1] == here[0] and covered[-1][2] <= here[1] <= covered[-1][3]:
                        covered[-1][3] = max(covered[-1][3], until)
                    else:
                        covered.append([None, *here, until, None, None])
            yield rows(covered)
            if held > HELD:
                yield firsts()
                first, held = {}, 0
        yield firsts()

    return packed.join(by_doc, "doc").mapInArrow(cut, CONTEXTS)


def _later(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which members of groups of equal windows are not the earliest of their group."""
    order = np.lexsort((start, doc, group))
    later = np.zeros(group.size, bool)
    later[order[1:]] = group[order[1:]] == group[order[:-1]]
    return later


def _stretches(doc: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Covered stretches of windows that begin at ``start``, overlapping ones joined."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + WINDOW))[: doc.size]
    begin = np.flatnonzero(new)
    end = start[np.append(begin[1:], doc.size) - 1] + WINDOW if begin.size else start
    return pa.record_batch([pa.array(doc[begin]), pa.array(start[begin]), pa.array(end)], names=["doc", "begin", "end"])


COVERED = "doc bigint, begin bigint, end bigint"


def _sorted_repeats(strings: DataFrame) -> DataFrame:
    """Covered stretches from contexts that meet by anchor; every anchor has a bounded number of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # distinct contexts of finished anchors that have two or more
        open_: pa.RecordBatch | None = None  # those of the last anchor seen
        size = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                rows = pa.Table.from_batches(held)
                group, owner, start = equal_windows(rows["string"].to_pylist(), WINDOW)
                doc = rows["doc"].to_numpy()[owner]
                start = start + rows["begin"].to_numpy()[owner]
                later = _later(group, doc, start)
                yield _stretches(doc[later], start[later])
            held, size = [], 0

        def take(rows: pa.RecordBatch) -> None:
            """Hold the distinct contexts of whole anchors, where they can repeat."""
            nonlocal size
            anchor, own = rows["anchor"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            count = np.diff(np.append(begin, anchor.size))
            good = np.repeat((count > 1) | np.logical_or.reduceat(own, begin), count)
            if good.any():
                held.append(rows.filter(pa.array(good)))
                size += pc.sum(pc.binary_length(held[-1]["string"])).as_py()

        for batch in batches:
            if not batch.num_rows:
                continue
            carried = open_.num_rows if open_ is not None else 0
            rows = pa.Table.from_batches([open_, batch] if carried else [batch]).combine_chunks().to_batches()[0]
            anchor, string = rows["anchor"].to_numpy(), rows["string"]
            like_last = np.append(False, anchor[1:] == anchor[:-1])
            like_last[1:] &= pc.equal(string.slice(1), string.slice(0, len(string) - 1)).to_numpy(zero_copy_only=False)
            if like_last.any():  # equal contexts come in the order of their places
                yield rows.select(["doc", "begin", "end"]).filter(pa.array(like_last))
            distinct = rows.filter(pa.array(~like_last))
            last = int(np.searchsorted(distinct["anchor"].to_numpy(), anchor[-1]))
            if last:
                take(distinct.slice(0, last))
            open_ = distinct.slice(last)
            if size > BLOCK:
                yield from finish()
        if open_ is not None:
            take(open_)
        yield from finish()

    ordered = strings.repartition("anchor").sortWithinPartitions("anchor", "string", "doc", "begin")
    return ordered.mapInArrow(search, COVERED)


def _window_repeats(strings: DataFrame) -> DataFrame:
    """Covered stretches from the contexts of crowded anchors, by aggregating their single windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, begin, string in zip(*(batch.column(c).to_pylist() for c in ("doc", "begin", "string"))):
                n = len(string) - WINDOW + 1
                yield _batch(
                    {
                        "window": ([string[i : i + WINDOW] for i in range(n)], pa.binary()),
                        "doc": ([doc] * n, pa.int64()),
                        "begin": (list(range(begin, begin + n)), pa.int64()),
                    }
                )

    rows = kept(strings.mapInArrow(windows, "window binary, doc bigint, begin bigint"), "windows")
    first = rows.groupBy("window").agg(F.min(F.struct("doc", "begin")).alias("first"))
    later = rows.join(first, "window").filter(F.struct("doc", "begin") > F.col("first"))
    return later.select("doc", "begin", (F.col("begin") + WINDOW).alias("end"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc, begin, end): stretches covered by a window that also starts earlier, of documents (doc, data bytes)."""
    cut = kept(_cut(_packed(docs), repeated_anchors(docs)), "contexts")
    strings = cut.filter("anchor is not null")
    crowded = strings.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("anchor")
    crowded = kept(crowded, "crowded")
    alone = cut.filter("anchor is null").select("doc", "begin", "end")
    few = _sorted_repeats(strings.join(crowded, "anchor", "left_anti").select(*strings.columns))
    return alone.union(few).union(_window_repeats(strings.join(crowded, "anchor", "left_semi")))


def _digested(data: bytes, stretches: list[tuple[int, int]]) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """n_bytes, n_removed, n_spans, digest of what is kept, and the maximal removed runs."""
    runs: list[list[int]] = []
    for begin, end in sorted(stretches):
        if runs and begin <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([begin, end])
    rest, at = hashlib.sha256(), 0
    for begin, end in runs:
        rest.update(data[at:begin])
        at = end
    rest.update(data[at:])
    return len(data), sum(e - b for b, e in runs), len(runs), rest.hexdigest(), [tuple(r) for r in runs]


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<begin:bigint,end:bigint>>"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed runs, in bytes).

    A byte is removed when a string of ``WINDOW`` bytes that covers it also starts earlier: in a document with a smaller
    doc_id, or before in the same one. Null texts are read as empty. Rows without doc_id repeat nothing and are returned
    as they are. Rows that share a doc_id are one document, with the smallest of their texts, returned once. Of equal strings
    the earliest stays. A very long text counts whole; one task holds it in memory when its bytes are removed. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), text.alias("text"))
    named = rows.filter("doc is not null")
    if not named.groupBy("doc").count().filter("count > 1").isEmpty():
        named = kept(named.groupBy("doc").agg(F.min("text").alias("text")), "one-text")
    as_bytes = lambda of: of.select("doc", F.encode("text", "utf-8").alias("data"))
    named = as_bytes(named)
    stretches = covered(named).groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("stretches"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 20):
            found = []
            for doc, packed, runs in zip(*(batch.column(c).to_pylist() for c in ("doc", "packed", "stretches"))):
                *told, spans = _digested(_unpack(packed), [(r["begin"], r["end"]) for r in runs or ()])
                found.append((doc, *told, [{"begin": b, "end": e} for b, e in spans]))
            columns = list(zip(*found)) if found else [()] * 6
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    every = _packed(named).join(stretches, "doc", "left")
    nameless = _packed(as_bytes(rows.filter("doc is null"))).withColumn("stretches", F.lit(None).cast(stretches.schema["stretches"].dataType))
    return every.select("doc", "packed", "stretches").union(nameless).mapInArrow(digest, RESULT)
