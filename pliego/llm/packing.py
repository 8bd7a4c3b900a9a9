"""Best-fit packing of tokenised documents into sequences, by exact-complement hashing.

Only lengths decide how pieces are combined, and there are at most ``capacity`` different lengths, so the plan is made
on the histogram of lengths: for the longest length left, the gap is looked up among the single lengths, the pair sums
and the triple sums still available; a combination that fills it exactly is taken as often as its counts allow.
What finds no exact complement is filled best-fit, and the rest of its gap is looked up again. The histogram and the
plan have a size that does not depend on the number of documents. Pieces get their place from their rank among the
pieces of their length, which is counted per task and added up over tasks.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.llm.common import per_worker, slices, text_or_empty
from pliego.session import kept

CAPACITY = 2048
END_ID = 0
CACHE_BYTES = 128 << 20  # of remembered units in a worker
CACHED_UNITS, CACHED_PARTS = 800_000, 10_000  # units, and different runs of punctuation, that are remembered at most
ENTRY_BYTES = 170  # of an entry besides its characters and ids
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # no apostrophe, which may belong to the letters after it

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer never merges across a single space or line end between visible characters, nor between a run of letters and
    the ASCII punctuation after it, so texts are cut there and the ids of each unit are remembered. Texts with other or
    double white space or with a special token are encoded in one go. New words of letters only go, many at once, to a
    byte-pair encoder with the same merges that makes ids alone, if the file numbers its merges in order.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.units: dict[str, bytes] = {}
        self.held = 0
        self.tails: dict[str, bytes] = {}
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([r"\s\s", r"[^\S \n]", *special]))
        self.line_end = self._encode(["\n"])[0]
        self.words = self._word_encoder(path)

    @staticmethod
    def _word_encoder(path: str):
        import json

        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, merges = model["vocab"], model.get("merges", [])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        in_order = len(pairs) > 0 and all(vocab.get(a + b) == 256 + n for n, (a, b) in enumerate(pairs))
        letters = sorted(ByteLevel.alphabet(), key=lambda c: vocab.get(c, -1))
        if not in_order or [vocab.get(c) for c in letters] != list(range(256)):
            return None
        # the byte-level alphabet shows printable Latin-1 bytes as themselves and the others from 256 on
        shown = [b for b in range(256) if chr(b) in letters]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocab.items() if n < 256 + len(pairs)}
        return tiktoken.Encoding("words", pat_str=r"\n| ?\p{L}+", mergeable_ranks=ranks, special_tokens={})

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (e.ids for e in found)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters, each with one space before it or none."""
        if self.words is None or not words:
            return self._encode(words) if words else []
        ids = self.words.encode_ordinary("\n".join(words))
        data = struct.pack(f"<{len(ids)}I", *ids)
        cuts = (np.flatnonzero(np.frombuffer(data, "<u4") == struct.unpack("<I", self.line_end)[0]) * 4).tolist()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)])]

    def _learn(self, units: set[str]) -> None:
        """Remember units and the words in them: a word, which follows a space, and the punctuation after it."""
        known, tails, line_end = self.units, self.tails, self.line_end
        cut, words, others = [], set(), set()
        for unit in units:
            stem = unit.rstrip(PUNCTUATION)
            first = stem[:1] == "\n"
            word = stem[1:] if first else " " + stem
            if not (word if first else stem).isalpha():
                word, stem, first = (unit if unit[:1] == "\n" else " " + unit), unit, False
                others.add(word)
            else:
                words.add(word)
            tail = unit[len(stem) :]
            if tail and tail not in tails:
                others.add(tail)
            cut.append((unit, first, word, tail))
        parts = {w: known[w[1:]] for w in words if w[0] == " " and w[1:] in known}
        new = [w for w in words if w not in parts]
        ids_of_new = self._encode_words(new)
        before = len(known)
        known.update((w[1:], ids) for w, ids in zip(new, ids_of_new) if w[0] == " ")
        parts.update(zip(new, ids_of_new))
        new = list(others)
        parts.update(zip(new, self._encode(new)))
        size = 0
        for unit, first, word, tail in cut:
            ids = parts[word]
            if tail:
                end = tails.get(tail)
                if end is None:
                    if len(tails) >= CACHED_PARTS:
                        tails.clear()
                    end = tails[tail] = parts[tail] if tail in parts else self._encode([tail])[0]
                ids += end
            known[unit] = ids = line_end + ids if first else ids
            size += len(unit) + len(ids)
        self.held += size + ENTRY_BYTES * (len(known) - before)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.whole.search(text):
            return self._encode([text])[0]
        head, *rest = text.replace("\n", " \n").split(" ")
        known = self.units
        missing = {u for u in rest if u not in known}
        if missing:
            if self.held > CACHE_BYTES or len(known) + len(missing) > CACHED_UNITS:
                known.clear()
                self.held = 0
                missing = set(rest)
            self._learn(missing)
        return b"".join([*(self._encode([head]) if head else []), *map(known.__getitem__, rest)])


def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept from task to task."""
    return per_worker(f"encoder {path}", lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Cut every document into pieces of at most ``capacity`` ids, the first one taking what is over.

    ``place`` is the number of earlier pieces of that length in the same task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, encode = TaskContext.get().partitionId(), Counter(), encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                edges = [0, *range((total - 1) % capacity + 1, total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, seen[b - a]))
                    seen[b - a] += 1
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"],
            )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(cut, PIECES)


class Stock:
    """How many pieces of each length are left, with an index of the sums of their pairs."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.counts = np.zeros(capacity + 1, np.int64)
        self.pairs = np.zeros(capacity + 1, np.int64)  # by sum: pairs of lengths at hand
        for length, n in histogram.items():
            self._note(length, n)

    def take(self, length: int, n: int = 1) -> None:
        self._note(length, -n)

    def _note(self, length: int, n: int) -> None:
        before, after = int(self.counts[length]), int(self.counts[length]) + n
        self.counts[length] = after
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.counts[: max(self.counts.size - length, 0)])
            others = others[others != length]
            self.pairs[others + length] += 1 if after > 0 else -1
        if 2 * length < self.pairs.size:
            self.pairs[2 * length] += int(after > 1) - int(before > 1)

    def pair(self, gap: int) -> list[int]:
        """Two lengths that sum to ``gap``, those at hand most often first; else nothing."""
        if not self.pairs[gap]:
            return []
        low = np.arange(1, gap // 2 + 1)
        often = np.minimum(self.counts[low], self.counts[gap - low])
        if gap % 2 == 0:
            often[-1] = self.counts[gap // 2] // 2
        a = int(low[often.argmax()])
        return [gap - a, a]

    def triple(self, gap: int) -> list[int]:
        """Three lengths that sum to ``gap``, with the longest one possible: what it leaves is looked up in the pair sums."""
        there = np.flatnonzero(self.counts[:gap])[::-1]
        for a in there[self.pairs[gap - there] > 0].tolist():
            self.counts[a] -= 1  # the pair must do without it
            b = np.flatnonzero(self.counts[: gap - a])
            c = gap - a - b
            fits = (self.counts[c] > 0) & ((b != c) | (self.counts[b] > 1))
            self.counts[a] += 1
            if fits.any():
                b = int(b[fits.argmax()])
                return [a, b, gap - a - b]
        return []

    def complement(self, gap: int) -> list[int]:
        """One, two or three lengths at hand that sum to ``gap``; else nothing."""
        return [gap] if self.counts[gap] else self.pair(gap) or self.triple(gap)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """How often to build a sequence of which lengths: (number of sequences, lengths in order)."""
    stock, patterns = Stock(histogram, capacity), []
    for length in range(capacity, 0, -1):
        while stock.counts[length]:
            pattern, gap = [length], capacity - length
            stock.take(length)
            while gap:
                found = stock.complement(gap)
                if not found:
                    fitting = np.flatnonzero(stock.counts[: gap + 1])
                    if not fitting.size:
                        break
                    found = [int(fitting[-1])]
                for x in found:
                    stock.take(x)
                    gap -= x
                pattern += found
            uses = Counter(pattern)
            more = min(int(stock.counts[x]) // n for x, n in uses.items())
            if more:
                for x, n in uses.items():
                    stock.take(x, more * n)
            patterns.append((more + 1, pattern))
    return patterns


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first rank of each run of ranks, sequence of that rank, place in the sequence."""
    taken, runs, sequence = Counter(), {}, 0
    for times, pattern in patterns:
        offset = 0
        for length in pattern:
            runs.setdefault(length, []).append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*r)) for length, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the end id
    alone; repeated rows are packed each; rows without doc_id too; other columns are ignored; an empty table gives no
    rows. Ties between pieces of one length go by their order of reading. A very long text is encoded whole, by one task
    that holds it and its ids in memory, and cut into as many pieces as it needs.
    """
    cut = kept(pieces(docs, tokenizer, capacity), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(histogram, capacity))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == length)
                first, base, place = slots[length]
                run = np.searchsorted(first, ranks[here], "right") - 1
                sequence[here] = base[run] + ranks[here] - first[run]
                offset[here] = place[run]
            yield pa.record_batch(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return (
        cut.join(bases, ["length", "task"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
        .mapInArrow(assign, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    )
