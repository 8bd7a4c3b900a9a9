"""One summary per file, built from the head of its text only, and joined back to every chunk."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from pliego import constants as K
from pliego.functions import text as X
from pliego.operators.metadata import chunk_placed

BLOCK = 4096
TOTALS = ["total_pages", "total_chunks", "total_chars"]


def text_pieces(placed: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """The joined text of each file as ordered pieces: joining ``piece`` in chunk order gives the whole text.

    A file may be larger than any value or task, so the text is not built as one string."""
    chunks = chunk_placed(placed, size, overlap)
    last = F.col("chunk_index") == F.col("total_chunks") - 1
    return chunks.select(
        "source",
        "chunk_index",
        "char_start",
        F.when(last, F.col("page_content")).otherwise(F.concat("page_content", F.lit("\n"))).alias("piece"),
        F.col("total_chars").alias("document_chars"),
    )


def document_heads(placed: DataFrame, limit: int, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """(source, totals, head): the first ``limit`` characters of each file's joined text.

    ``placed`` may be the pages of ``head_pages`` alone. Pages and chunks that start later are dropped before grouping; each kept chunk adds at least one character, so
    a group holds at most ``limit + 1`` of them."""
    chunks = chunk_placed(placed.filter(F.col("char_start") <= limit), size, overlap).filter(F.col("char_start") <= limit)
    return (
        chunks.groupBy("source")
        .agg(
            *[F.max(c).alias(c) for c in TOTALS],
            F.array_sort(F.collect_list(F.struct("chunk_index", "page_content"))).alias("parts"),
        )
        .select(
            "source",
            *TOTALS,
            F.substring(F.array_join(F.transform("parts", lambda p: p["page_content"]), "\n"), 1, limit).alias("head"),
        )
    )


def cut(head: Column, total: Column, limit: int = K.SUMMARY_CHARS) -> Column:
    """First ``limit`` characters, with dots when the text goes on."""
    return F.when(total > limit, F.concat(F.substring(head, 1, limit), F.lit("..."))).otherwise(head)


def simple_summaries(
    placed: DataFrame, limit: int = K.SUMMARY_CHARS, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    heads = document_heads(placed, limit, size, overlap)
    return heads.select("source", *TOTALS, cut(F.col("head"), F.col("total_chars"), limit).alias("document_summary"))


def guarded(text: Column, proposed: Column, limit: int = K.SUMMARY_CHARS) -> Column:
    """Short texts are their own summary; a proposed summary is cut to ``limit``."""
    return F.when(F.length(text) < K.SUMMARY_MIN_TEXT, text).otherwise(X.clip(proposed, limit))


def model_input(text: Column) -> Column:
    return F.substring(text, 1, K.SUMMARY_INPUT_CHARS)


def best_sentences(limit: int):
    """A function from the head of a text to its sentences with the most frequent words (term-frequency extraction,
    Luhn 1958): best first while they fit into ``limit`` characters, then in text order. Null when none fits."""

    def choose(sentences: list[str], tokens: list[list[str]]) -> str | None:
        frequency = Counter(t for words in tokens for t in words)
        scored = [
            (-sum(frequency[t] for t in words) / len(words), no)
            for no, words in enumerate(map(lambda w: [t for t in w if t], tokens)) if words
        ]
        chosen, used = [], 0
        for _, no in sorted(scored):
            used += len(sentences[no]) + 2
            if used > limit + 2:
                break
            chosen.append(no)
        return ". ".join(sentences[no] for no in sorted(chosen)) or None

    @F.arrow_udf(StringType())
    def extract(heads: pa.Array) -> pa.Array:
        parts = pc.split_pattern_regex(heads, pattern=r"[.\n]")
        sentences = pc.utf8_trim(parts.flatten(), characters=K.PYTHON_BLANKS)
        tokens = pc.split_pattern_regex(pc.utf8_lower(sentences), pattern=K.TOKEN_BREAK)
        ends = parts.offsets.to_numpy()
        return pa.array(
            [choose(sentences[a:b].to_pylist(), tokens[a:b].to_pylist()) for a, b in zip(ends - ends[0], ends[1:] - ends[0])],
            pa.string(),
        )

    return extract


def extractive_summaries(
    placed: DataFrame, limit: int = K.SUMMARY_CHARS, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    """Best sentences of each file's head, or its first ``limit`` characters; short files are their own summary.

    The head is at most 5,000 characters, so counting its words needs no shuffle."""
    heads = document_heads(placed, K.SUMMARY_INPUT_CHARS, size, overlap)
    proposed = F.coalesce(best_sentences(limit)("head"), cut(F.col("head"), F.col("total_chars"), limit))
    short = F.col("total_chars") < K.SUMMARY_MIN_TEXT
    return heads.select(
        "source", *TOTALS, F.when(short, F.col("head")).otherwise(X.clip(proposed, limit)).alias("document_summary")
    )


def attach_summaries(rows: DataFrame, summaries: DataFrame, index: str, total: str, block: int = BLOCK) -> DataFrame:
    """Add ``document_summary`` to every row, "" when the file has none.

    ``index`` numbers the rows of a file from 0 and ``total`` is their number, as known with the summary. A file with
    a third of all rows would be one join key; its summary is copied once per ``block`` rows instead, and rows meet
    the copy of their own block."""
    copies = summaries.select(
        "source", "document_summary", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"{total} div {block}"))).alias("_block")
    )
    return (
        rows.withColumn("_block", F.expr(f"{index} div {block}"))
        .join(copies, ["source", "_block"], "left")
        .drop("_block")
        .withColumn("document_summary", F.coalesce("document_summary", F.lit("")))
    )


def prefix_first(content: Column, summary: Column, index: Column) -> Column:
    """The first chunk of a file opens with the summary; a chunk without an index counts as the first."""
    return F.when(
        F.coalesce(index, F.lit(0)) == 0,
        F.concat(F.lit(f"{K.SUMMARY_HEADING}\n"), summary, F.lit(f"\n\n{K.FIRST_CHUNK_HEADING}\n"), content),
    ).otherwise(content)
