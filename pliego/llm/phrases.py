"""Collocations: phrases whose words go together more often than their parts would.

Only the longest windows are counted: each word with the words that follow it in its piece, padded at the piece's end. A
shorter phrase's count is the sum over the windows that begin with it, and Spark's ROLLUP takes those sums for all
shorter prefixes at once, so no n-gram table but the longest is ever made.

Most windows are rare. A window below the least count can be no phrase, so its count may stand for its first words alone: it is
*folded* into the window that is padded one word earlier. Windows are gathered by their hash, in packed rows, so that
each bucket sees all counts of its windows; it keeps the frequent ones, folds the others, and the shorter windows meet in the
next stage, down to single words. No count is lost, sums over prefixes stay exact, and ROLLUP gets few rows. A bucket
is a share of the whole windows' hashes, so a word or a pair that a third of all windows begin with is in all buckets.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from pliego.llm.common import slices, text_or_empty
from pliego.llm.near import mixed
from pliego.session import kept

ORDER, LEAST, BEST, SHARE = 3, 10, 2000, 50
UNKNOWN = "und"
BLOCK = 1 << 19  # words whose windows are counted together
SEGMENT = 1 << 20  # bytes of a text that are read at once, up to the next blank
BUCKET = 4 << 20  # bytes of text per bucket
MILLION = 1_000_000

_MARKS = b".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes(range(65, 91))
PLAIN = bytes.maketrans(_LETTERS + _MARKS + b"\t", _LETTERS.lower() + b"." * len(_MARKS) + b" ")
END = b"."


class _Numbers(dict):
    """Words of one language by their number in the block; 0 is the end of a piece."""

    def __init__(self, words: list[bytes]):
        super().__init__({END: 0})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


class Block:
    """Numbered words of some texts. Each language numbers its own words, so a window's first word tells its language."""

    def __init__(self, order: int):
        self.order, self.words, self.languages, self.parts, self.size = order, [b""], {}, [], 0

    def take(self, plain: bytes, lang: bytes) -> None:
        if lang not in self.languages:
            self.languages[lang] = _Numbers(self.words)
        tokens = plain.replace(END, b" . ").split()
        self.parts.append(np.fromiter(map(self.languages[lang].__getitem__, tokens), np.int64, len(tokens)))
        self.size += len(tokens)

    def end(self) -> None:
        """The end of a text is the end of a piece."""
        self.parts.append(np.zeros(self.order, np.int64))

    def tail(self) -> bytes:
        """The last words, whose windows need the words to come."""
        last = np.concatenate(self.parts)[1 - self.order :] if self.order > 1 else []
        return b" ".join(self.words[i] or END for i in last)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct padded windows (one row of word numbers each) and their counts."""
        words = np.concatenate([np.zeros(0, np.int64), *self.parts])
        starts = max(0, len(words) - self.order + 1)
        lead = [words[i : i + starts] for i in range(self.order)]
        inside, padded = lead[0] > 0, [lead[0]]
        for column in lead[1:]:
            inside = inside & (column > 0)
            padded.append(np.where(inside, column, 0))
        padded = [column[lead[0] > 0] for column in padded]
        bits = len(self.words).bit_length()
        if bits * self.order > 63:
            return np.unique(np.stack(padded, axis=1), axis=0, return_counts=True)
        key = padded[0]
        for column in padded[1:]:
            key = (key << bits) | column
        keys, counts = np.unique(key, return_counts=True)
        shifts = np.arange(self.order - 1, -1, -1) * bits
        return (keys[:, None] >> shifts[None, :]) & ((1 << bits) - 1), counts

    def packed(self, buckets: int) -> pa.RecordBatch:
        """The counted windows as packed rows: language and words as one line, dealt by a hash of all of them."""
        numbers, counts = self.windows()
        first, hashes = list(self.words), np.fromiter(map(zlib.crc32, self.words), np.uint64, len(self.words))
        lead = hashes.copy()
        for lang, known in self.languages.items():
            head = lang.hex().encode() + b" "
            mine = np.fromiter(known.values(), np.int64, len(known))[1:]
            lead[mine] ^= np.uint64(zlib.crc32(head) << 32)
            for number in mine.tolist():
                first[number] = head + first[number]
        mix = lead[numbers[:, 0]]
        for column in numbers.T[1:]:
            mix = mixed(mix) + hashes[column]
        at = (mixed(mix) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        numbers = numbers[order]
        columns = [map(first.__getitem__, numbers[:, 0].tolist())]
        columns += [map(self.words.__getitem__, column.tolist()) for column in numbers.T[1:]]
        return packed(list(map(b" ".join, zip(*columns))), counts[order], at[order])


def packed(lines: list[bytes], counts: np.ndarray, buckets: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, counts, lines) of lines that are in the order of their buckets, compressed."""
    edges = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
    cuts = list(zip(edges, [*edges[1:], len(lines)]))
    columns = [
        pa.array([int(buckets[a]) for a, _ in cuts], pa.int32()),
        pa.array([zlib.compress(counts[a:b].astype("<i8").tobytes(), 1) for a, b in cuts], pa.binary()),
        pa.array([zlib.compress(b"\n".join(lines[a:b]), 1) for a, b in cuts], pa.binary()),
    ]
    return pa.record_batch(columns, names=["bucket", "counts", "lines"])


def blocks(texts: Iterator[tuple[bytes, bytes]], order: int) -> Iterator[Block]:
    """Blocks of the (lang, text) pairs. A long text is read in segments and may go on in the next block, which then
    begins with the words whose windows were not complete."""
    block = Block(order)
    for lang, text in texts:
        plain, at = text.translate(PLAIN), 0
        while at < len(plain):
            end = plain.find(b" ", at + SEGMENT)
            end = len(plain) if end < 0 else end
            block.take(plain[at:end], lang)
            at = end
            if block.size >= BLOCK and at < len(plain):
                rest = block.tail()
                yield block
                block = Block(order)
                block.take(rest, lang)
        block.end()
        if block.size >= BLOCK:
            yield block
            block = Block(order)
    if block.size:
        yield block


def _counted(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (
            (lang.encode("utf-8", "surrogatepass"), text.as_buffer().to_pybytes())
            for batch in slices(batches, "text")
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"))
        )
        for block in blocks(texts, order):
            yield block.packed(buckets)

    return docs.mapInArrow(scan, "bucket int, counts binary, lines binary")


def _folded(gathered: DataFrame, order: int, length: int, least: int, buckets: int) -> DataFrame:
    """One stage: windows of ``length`` words (and padding) with all their counts in one bucket.

    Frequent windows come out as rows (lang, words, n); the others are folded into windows of one word less, which go on as
    packed rows. The first words of a frequent window have to stay a window of their own, so they go on marked by
    a negative count: -1 - n."""

    def merge(some: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        marked: set[bytes] = set()
        for counts, lines in zip(some.column("counts"), some.column("lines")):
            some_lines = zlib.decompress(lines.as_py()).split(b"\n")
            n = np.frombuffer(zlib.decompress(counts.as_py()), "<i8")
            if (n < 0).any():
                marked.update(compress(some_lines, (n < 0).tolist()))
                n = np.where(n < 0, -1 - n, n)
            for line, k in zip(some_lines, n.tolist()):
                total[line] += k
        lines, n = list(total), np.fromiter(total.values(), np.int64, len(total))
        del total
        stays = n >= least
        if marked:
            stays |= np.fromiter(map(marked.__contains__, lines), bool, len(lines))
        frequent = [i for i in np.flatnonzero(stays).tolist() if not lines[i].endswith(b" ")]
        rows = [(lines[i], int(n[i])) for i in frequent if n[i]]
        n[frequent] = 0  # what is rare, or padded already, belongs to the words before
        heads = [line[: line.rfind(b" ")] for line in lines]
        pinned = {heads[i] for i in frequent}
        shorter: dict[bytes, int] = defaultdict(int)
        for head, k in zip(heads, n.tolist()):
            shorter[head] += k
        onward = packed([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        if length > 1:
            lines = list(shorter)
            at = np.fromiter(map(zlib.crc32, lines), np.int64, len(lines)) % buckets
            n = np.fromiter((-1 - k if x in pinned else k for x, k in shorter.items()), np.int64, len(lines))
            dealt = np.argsort(at, kind="stable")
            onward = packed([lines[i] for i in dealt.tolist()], n[dealt], at[dealt])
        else:  # what is left is the language: the rest of its words
            rows += [(line + b" ", k) for line, k in shorter.items() if k]
        cut = [line.split(b" ") for line, _ in rows]
        fine = pa.table(
            {
                "lang": pa.array([bytes.fromhex(c[0].decode()).decode("utf-8", "replace") for c in cut], pa.string()),
                "words": pa.array([[w.decode("utf-8", "replace") for w in c[1:]] + [""] * (order - len(c) + 1) for c in cut], pa.list_(pa.string())),
                "n": pa.array([n for _, n in rows], pa.int64()),
            }
        )
        return pa.concat_tables([fine, pa.Table.from_batches([onward])], promote_options="default")

    return gathered.groupBy("bucket").applyInArrow(merge, "lang string, words array<string>, n bigint, bucket int, counts binary, lines binary")


def longest_windows(docs: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(lang, words, n): padded windows of ``order`` words whose sums over prefixes are the counts of all words and of all
    phrases that occur ``least`` times; rarer windows are folded into shorter ones."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // BUCKET + 1
    left, found = _counted(texts.select("lang", F.col("text").cast("binary").alias("text")), order, buckets), None
    for length in range(order, 0, -1):
        stage = kept(_folded(left, order, length, least, buckets), f"windows-{length}")
        rows = stage.filter("lang is not null").select("lang", "words", "n")
        found = rows if found is None else found.union(rows)
        left = stage.filter("bucket is not null").select("bucket", "counts", "lines")
    return found


def counts(windows: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(lang, size, phrase, a) of every phrase that occurs ``least`` times, and with size 0 the number of words of each lang."""
    names = [f"w{i + 1}" for i in range(order)]
    columns = windows.select("lang", "n", *[F.col("words")[i].alias(n) for i, n in enumerate(names)])
    rolled = columns.rollup("lang", *names).agg(F.sum("n").alias("a"), F.grouping_id().alias("g"))
    size = F.greatest(order - F.bit_count("g"), F.lit(0)).cast("int")  # the words that are not summed over
    words = F.array(*names)
    padded = F.array_contains(F.slice(words, 1, F.col("size")), "")  # sums of windows that end before this length
    rows = rolled.filter("lang is not null").withColumn("size", size).filter(~F.coalesce(padded, F.lit(False)))
    return rows.filter((F.col("size") == 0) | (F.col("a") >= least)).select(
        "lang", "size", F.array_join(F.slice(words, 1, F.col("size")), " ").alias("phrase"), "a"
    )


def _part(words: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def collocations(docs: DataFrame, order: int = ORDER, least: int = LEAST, best: int = BEST, share: int = SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's ``best`` phrases of 2 to ``order`` words of documents (text, lang).

    A null text is empty, a null lang is ``und``; every row counts, also repeated ones; doc_id is not needed. Texts are
    cut into blocks of words, so a very long one only makes its block as long. Of cuts with equal scores the first counts;
    phrases with equal scores go by count and then by bytes. A phrase is dropped when a longer one around it occurs at least
    ``share`` percent as often. Counts are exact; products are decimals of 38 digits. No words or no
    phrases: no rows. Other columns are ignored.
    """
    known = kept(counts(longest_windows(docs, order, least), order, least), "phrases")
    phrases = known.filter("size > 1").withColumn("words", F.split("phrase", " "))
    parts = known.filter("size > 0")
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "a", "words", "size", k)
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("first"), _part("words", F.col("k") + 1, F.col("size")).alias("rest"))
    of_first = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    of_rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    whole = {c: F.col(c).cast("decimal(19,0)").alias(c) for c in "alr"}
    score = f"cast(cast({MILLION} as decimal(7,0)) * cast(x.a * x.a as decimal(31,0)) div (x.l * x.r) as bigint)"
    scored = cuts.join(of_first, ["lang", "first"]).join(of_rest, ["lang", "rest"]).withColumn("x", F.struct(*whole.values()))
    lowest = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("m")
    scored = scored.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    # the phrases inside a longer one, which hide behind it when it is frequent enough
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _part("words", i, m)),
        )
    )
    around = phrases.filter("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stay = scored.join(around, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {share} * a")
    ranked = stay.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).filter(F.col("rank") <= best)
    totals = known.filter("size = 0").select("lang", F.col("a").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
    ), grams AS (
        SELECT lang, m AS size, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m
    ), f AS (
        SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
    ), total AS (
        SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
    ), candidate AS (
        SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10
    ), cuts AS (
        SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:k], ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
    ), scored AS (
        SELECT lang, phrase, a, arg_min((l, r), (score, k)) AS lr, min(score) AS score FROM cuts GROUP BY ALL
    ), around AS (
        SELECT lang, phrase, max(a) AS longer FROM (
            SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM candidate WHERE size = 3
        ) GROUP BY ALL
    ), ranked AS (
        SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank
        FROM scored s LEFT JOIN around o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.a
    )
    SELECT lang, rank, phrase, a, lr[1] AS l, lr[2] AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
