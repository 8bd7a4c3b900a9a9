"""Scans, chunking, metadata, summaries and the ingest job over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pliego import constants as K
from pliego.functions import text as X
from pliego.functions.vectors import embed
from pliego.operators import chunking, metadata, summaries
from pliego.session import kept, shared_folder
from pliego.sources import store, tables

PROCESSED = "2024-01-01T00:00:00"
SWEEP = [(300, 0), (500, 100), (1000, 200), (2000, 400)]


def vector_digest(vector: Column) -> Column:
    """A whole number that changes with any coordinate of a vector."""
    terms = F.transform(vector, lambda x, i: F.round(x.cast("double") * 1000).cast("bigint") * (i + 1))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + x)


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.place_pages(tables.pages(spark, sf_dir))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages by their lengths alone, without text."""
    return metadata.place(metadata.page_sizes(tables.pages(spark, sf_dir)))


def told_places(
    pages: DataFrame, sizes: DataFrame, summary, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP
) -> DataFrame:
    """Placed pages, without text, with the summary of their file, which is made from the heads of the files."""
    placed_ = kept(metadata.place(sizes), "places")
    heads = metadata.head_pages(placed_, pages, K.SUMMARY_INPUT_CHARS, size)
    return summaries.attach_summaries(placed_, summary(heads, size=size, overlap=overlap), "page", "total_pages")


def chunk_store(
    spark: SparkSession,
    sf_dir: str,
    processed: str = PROCESSED,
    summary=summaries.extractive_summaries,
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """The ingest job up to the write: pages -> summaries -> chunks -> metadata -> vectors."""
    return chunks_of(tables.pages(spark, sf_dir), processed, summary, size, overlap)


def chunks_of(
    pages: DataFrame,
    processed: str = PROCESSED,
    summary=summaries.extractive_summaries,
    size: int = K.CHUNK_SIZE,
    overlap: int = K.CHUNK_OVERLAP,
) -> DataFrame:
    """Chunks with metadata, summaries and vectors of pages (source, doc_id, page_content). Summaries meet the numbers
    first and the whole text last, so it is moved once however large a file is."""
    told = told_places(pages, kept(metadata.page_sizes(pages, size, overlap), "sizes"), summary, size, overlap)
    cut = metadata.enrich(metadata.chunk_placed(metadata.with_text(told, pages), size, overlap), F.lit(processed))
    opened = cut.withColumn(
        "page_content", summaries.prefix_first(F.col("page_content"), F.col("document_summary"), F.col("chunk_index"))
    )
    return opened.withColumn("embedding", embed(F.col("page_content")))


def saved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "store")
    store.save(chunk_store(spark, sf_dir), path)
    return store.load(spark, path)


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("source", "doc_id", "page", "page_content", "total_pages")


def filter_sources_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.filter_by_type(tables.read(spark, sf_dir, "pages").select("page_id", "url"), "url", "HTML")


def chunk_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.conv(F.substring(F.md5(F.col("page_content").cast("binary")), 1, 7), 16, 10).cast("bigint")
    return saved_store(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.length("page_content")).cast("bigint").alias("chars"),
        F.sum(content).alias("content_digest"),
        F.sum(vector_digest(F.col("embedding"))).alias("vector_digest"),
    )


def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = saved_store(spark, sf_dir)
    return saved.withColumn("vector_digest", vector_digest(F.col("embedding"))).drop("embedding")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.pages(spark, sf_dir)
    told = told_places(pages, metadata.page_sizes(pages), summaries.simple_summaries)
    has, count = F.col("document_summary") != "", F.col("chunks")
    return told.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(count).alias("chunks"),
        F.sum(F.when(has, count).otherwise(0)).alias("chunks_with_summary"),
        F.max(has.cast("bigint")).alias("documents_summarised"),
    )


def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.ocr_routing(tables.pages(spark, sf_dir))


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_fixed(tables.pages(spark, sf_dir).select("doc_id", "page_content"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_recursive(tables.pages(spark, sf_dir).select("doc_id", "page_content"))


def chunk_param_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sweep(tables.pages(spark, sf_dir), SWEEP)


def chunk_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.invariant_violations(tables.pages(spark, sf_dir).select("doc_id", "page_content"))


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.chunk_places(places(spark, sf_dir)).select("source", "page", "pos", "chunk_index")


def with_gaps(pages: DataFrame) -> DataFrame:
    """Pages, with their length, as a poor loader gives them: short ones without a source, long ones without a page number."""
    size = F.col("length")
    gaps = {"source": F.when(size >= 300, F.col("source"))}
    if "page" in pages.columns:
        gaps["page"] = F.when(size <= 5000, F.col("page"))
    return pages.withColumns(gaps)


def unnumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(tables.pages(spark, sf_dir).withColumn("length", F.length("page_content")))


def default_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unnumbered(spark, sf_dir).select("doc_id", metadata.default_source(F.col("source")).alias("source"))


def file_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = unnumbered(spark, sf_dir)
    return pages.select("doc_id", X.file_name(F.coalesce("source", F.lit(""))).alias("file_name"))


def processed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = metadata.enrich(metadata.chunk_places(places(spark, sf_dir)), F.lit(PROCESSED))
    return cut.groupBy("source").agg(
        F.min("processed_date").alias("first_date"), F.max("processed_date").alias("last_date"), F.count(F.lit(1)).alias("chunks")
    )


def default_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_gaps(places(spark, sf_dir)).select("doc_id", metadata.default_page(F.col("page")).alias("page"))


def enrich_chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = metadata.chunk_placed(with_gaps(placed(spark, sf_dir)))
    return metadata.enrich(cut, F.lit(PROCESSED)).select(
        "chunk_id", "source", "file_name", "page", "chunk_index", "processed_date", "page_content"
    )


def extract_source_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = metadata.chunk_places(with_gaps(places(spark, sf_dir))).withColumn("file_name", X.file_name(F.col("source")))
    return cut.select("chunk_id", metadata.source_info(cut).alias("i")).select("chunk_id", "i.*")


def clean_file_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", X.base_name(F.col("url")).alias("name"))


def process_documents_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without metadata: without it no chunk has an index, so each one is taken for the first."""
    pages = tables.pages(spark, sf_dir)
    told = told_places(pages, metadata.page_sizes(pages), summaries.simple_summaries)
    cut = metadata.chunk_placed(metadata.with_text(told, pages)).withColumn("add_metadata", F.explode(F.array(F.lit(True), F.lit(False))))
    index = F.when(F.col("add_metadata"), F.col("chunk_index"))
    content = summaries.prefix_first(F.col("page_content"), F.col("document_summary"), index)
    return cut.select("add_metadata", "chunk_id", index.alias("chunk_index"), content.alias("page_content"))


def concat_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.text_pieces(placed(spark, sf_dir))


def heads(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    pages = tables.pages(spark, sf_dir)
    return metadata.head_pages(metadata.place(metadata.page_sizes(pages)), pages, limit)


def simple_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.simple_summaries(heads(spark, sf_dir, K.SUMMARY_CHARS)).select("source", "document_summary")


def summary_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("page_content")
    given = summaries.model_input(text)
    return tables.pages(spark, sf_dir).select(
        "doc_id", F.length(given).cast("bigint").alias("model_chars"), summaries.guarded(text, given).alias("summary")
    )


def attach_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = summaries.simple_summaries(heads(spark, sf_dir, K.SUMMARY_CHARS))
    cut = metadata.chunk_places(places(spark, sf_dir))
    return summaries.attach_summaries(cut, told, "chunk_index", "total_chunks").select("chunk_id", "source", "document_summary")


def prefix_first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.pages(spark, sf_dir)
    told = told_places(pages, metadata.page_sizes(pages), summaries.simple_summaries)
    content = summaries.prefix_first(F.col("page_content"), F.col("document_summary"), F.col("chunk_index"))
    return metadata.chunk_placed(metadata.with_text(told, pages)).select("chunk_id", content.alias("page_content"))


def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.extractive_summaries(heads(spark, sf_dir, K.SUMMARY_INPUT_CHARS)).select("source", "document_summary")


def embed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = tables.pages(spark, sf_dir).select("doc_id", F.posexplode(embed(F.col("page_content"))).alias("bucket", "w"))
    return vectors.filter("w > 0").select("doc_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_pages, filter_sources_by_type, chunk_store_roundtrip, ingest_documents, ingest_counts, ocr_routing,
        chunk_fixed, chunk_recursive, chunk_param_sweep, chunk_invariants,
        chunk_index, default_source, file_name, processed_date, default_page, enrich_chunk_metadata,
        extract_source_info, clean_file_path, process_documents_flags,
        concat_document_text, simple_summary, summary_guards, attach_document_summary, prefix_first_chunk,
        extractive_summary, embed_text,
    )
}
