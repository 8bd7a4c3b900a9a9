"""Numbering of pages and chunks, and the metadata every chunk carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pliego import constants as K
from pliego.functions import text as X
from pliego.operators.chunking import chunk_fixed, piece_chars, piece_count
from pliego.operators.ordering import running_totals
from pliego.session import kept


def default_source(source: Column, name: str = K.DEFAULT_SOURCE) -> Column:
    return F.coalesce(source, F.lit(name))


def default_page(page: Column) -> Column:
    return F.coalesce(page, F.lit(0)).cast("bigint")


def filter_by_type(manifest: DataFrame, path: str, file_type: str) -> DataFrame:
    """Files whose lower-cased path ends with the lower-cased type (no dot is asked for)."""
    return manifest.filter(F.endswith(F.lower(F.col(path)), F.lit(file_type.lower())))


def page_sizes(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """(source, doc_id, length, chunks, chars): what each page will give, from the length of its text alone. ``doc_id`` is
    the page's own id, unique over all files, and orders the pages of a file."""
    chars, chunk, over = F.length("page_content").cast("bigint"), F.lit(size), F.lit(overlap)
    return pages.select(
        "source",
        "doc_id",
        chars.alias("length"),
        piece_count(chars, chunk, over).alias("chunks"),
        piece_chars(chars, chunk, over).alias("chars"),
    )


def place(sizes: DataFrame) -> DataFrame:
    """Number the pages of each file and place them in its chunk list and in its joined chunk text.

    Gives source, doc_id, length, chunks, page, first_chunk, char_start, the totals of the file, and ``chunk_base``: the
    chunks of all pages before this one, so that a chunk's number over all files is its id."""
    values = {"page": F.lit(1), "first_chunk": F.col("chunks"), "char_start": F.col("chars") + F.col("chunks")}
    based = running_totals(sizes, [], "doc_id", {"chunk_base": F.col("chunks")}).drop("chunk_base_total")
    return running_totals(based, ["source"], "doc_id", values).select(
        "source",
        "doc_id",
        "length",
        "chunks",
        "chunk_base",
        "page",
        "first_chunk",
        "char_start",
        F.col("page_total").alias("total_pages"),
        F.col("first_chunk_total").alias("total_chunks"),
        (F.col("char_start_total") - 1).alias("total_chars"),
    )


def with_text(places: DataFrame, pages: DataFrame) -> DataFrame:
    """Placed pages with their text: the text is moved once, to its unique doc_id. The hint keeps a compressed text
    that looks small from being broadcast."""
    return pages.select("doc_id", "page_content").join(places.hint("merge"), "doc_id")


def head_pages(places: DataFrame, pages: DataFrame, limit: int, size: int = K.CHUNK_SIZE) -> DataFrame:
    """Placed pages that begin within the first ``limit`` characters of their file, with as much of their text as those
    characters need. These pages, few per file, are written first: Spark sees their size, and as long as it lets them be broadcast no
    text of the other pages is moved."""
    clipped = pages.select("doc_id", F.substring("page_content", 1, limit + size).alias("page_content"))
    return clipped.join(kept(places.filter(F.col("char_start") <= limit), "heads"), "doc_id")


def chunk_places(places: DataFrame) -> DataFrame:
    """One row per chunk of placed pages, without text: pos, chunk_index and chunk_id follow from the counts."""
    rows = places.withColumn("pos", F.explode(F.sequence(F.lit(0), (F.col("chunks") - 1).cast("int"))))
    return rows.withColumns({"chunk_index": F.col("first_chunk") + F.col("pos"), "chunk_id": F.col("chunk_base") + F.col("pos")})


def place_pages(pages: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    return with_text(place(page_sizes(pages, size, overlap)), pages)


def chunk_placed(placed: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of placed pages with chunk_index, char_start and chunk_id, the chunk's number over all files."""
    return chunk_fixed(placed, size, overlap).withColumns(
        {
            "chunk_index": F.col("first_chunk") + F.col("pos"),
            "char_start": F.col("char_start") + F.col("pos") * (size + 1),
            "chunk_id": F.col("chunk_base") + F.col("pos"),
        }
    )


def enrich(chunks: DataFrame, processed: Column, source_name: str = K.DEFAULT_SOURCE) -> DataFrame:
    """Fill source, file_name, processed_date and page of numbered chunks."""
    return (
        chunks.withColumn("source", default_source(F.col("source"), source_name))
        .withColumns(
            {
                "file_name": X.file_name(F.col("source")),
                "processed_date": processed,
                "page": default_page(F.col("page")),
            }
        )
    )


def source_info(chunks: DataFrame) -> Column:
    """The nine source fields as one struct; fields the input does not have are null."""
    def field(name: str, kind: str) -> Column:
        return (F.col(name) if name in chunks.columns else F.lit(None)).cast(kind).alias(name)

    return F.struct(
        F.coalesce(F.col("source"), F.lit(K.UNKNOWN_SOURCE)).alias("source"),
        field("file_name", "string"), field("page", "bigint"), field("chunk_index", "bigint"),
        field("processed_date", "string"), field("title", "string"), field("author", "string"),
        field("creator", "string"), field("total_pages", "bigint"),
    )


def ocr_routing(pages: DataFrame, minimum: int = K.OCR_MIN_CHARS) -> DataFrame:
    """Files with more than ``minimum`` characters are digital text, the others go to OCR."""
    return pages.groupBy("source").agg(F.sum(F.length("page_content")).cast("bigint").alias("chars")).select(
        "source", "chars", (F.col("chars") <= minimum).alias("ocr_processed")
    )
