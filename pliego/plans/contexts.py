"""Contexts, citations and source lists over the results of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pliego import constants as K
from pliego.functions import text as X
from pliego.operators import answers, context
from pliego.operators.ordering import row_index
from pliego.plans.ingest import places
from pliego.plans.retrieval import asked, index, results, with_unanswerable
from pliego.operators.rerank import search
from pliego.sources import tables

# The given pages have no cover labels, so their markup stands in for them.
MARKUP = {"title": r"<title>([^<]+)</title>", "language": r'<html lang="([a-z]+)"'}


def order_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of full size count as chunks without a page number here."""
    found = results(spark, sf_dir, K.DEFAULT_K)
    unnumbered = found.withColumn("page", F.when(F.length("page_content") < K.CHUNK_SIZE, F.col("page")))
    return context.order_by_page(unnumbered).select("query_id", "ord", "pos", "chunk_id", "page")


def clean_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(spark, sf_dir).select("doc_id", X.one_line(F.col("page_content")).alias("content"))


def format_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.contexts(results(spark, sf_dir), "pos").select("query_id", "context")


def search_and_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir, K.DEFAULT_K)
    ids = found.groupBy("query_id").agg(F.array_join(context.in_order("pos", F.col("chunk_id")), ",").alias("chunk_ids"))
    return context.contexts(found, "pos").join(ids, "query_id").select("query_id", "context", "chunk_ids")


def names_and_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, page as text): short pages have no name, longer ones no page or the text None."""
    size = F.col("length")
    return places(spark, sf_dir).select(
        "doc_id",
        F.when(size >= 300, X.file_name(F.col("source"))).alias("file_name"),
        F.when(size > 5000, F.lit("None")).when(size <= 2000, F.col("page").cast("string")).alias("page"),
    )


def source_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = names_and_pages(spark, sf_dir)
    return named.select("doc_id", X.source_annotation(F.col("file_name"), F.col("page")).alias("annotation"))


def annotated_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.annotated_contexts(results(spark, sf_dir, K.DEFAULT_K), "pos")


def format_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = names_and_pages(spark, sf_dir)
    return named.select("doc_id", X.citation(F.col("file_name"), F.col("page")).alias("citation"))


def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = with_unanswerable(asked(spark, sf_dir, K.DEFAULT_K))
    listed = context.contexts(results(spark, sf_dir, K.DEFAULT_K), "pos").select("query_id", "source_list")
    return queries.select("query_id").join(listed, "query_id", "left").select(
        "query_id", F.coalesce("source_list", context.no_sources()).alias("source_list")
    )


def assemble_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the agent's search for every query, in page order, with its sources."""
    queries = with_unanswerable(asked(spark, sf_dir, K.AGENT_K))
    return context.assemble(queries, results(spark, sf_dir, K.AGENT_K))


def merge_citation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.merged_citations(results(spark, sf_dir, K.AGENT_K))


def cover_field_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages of one host are one source; its first two pages are searched for the labels."""
    web = tables.read(spark, sf_dir, "pages").select(
        F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("source"), "page_id", F.col("html").alias("page_content")
    )
    numbers = row_index(web.select("source", "page_id"), ["source"], "page_id", "page")
    # every source has a first page, so none is lost; only these pages' markup is moved
    front = numbers.withColumn("page", F.col("page") + 1).filter(F.col("page") <= 2)
    numbered = web.drop("source").join(front, "page_id")
    return answers.cover_fields(numbered, MARKUP, K.COVER_IGNORE)


def verify_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in the answers of a conversation, checked against the search with the conversation's number."""
    said = tables.answers(spark, sf_dir).withColumnRenamed("conv_id", "query_id")
    found = search(asked(spark, sf_dir, K.DEFAULT_K), index(spark, sf_dir))
    return answers.verify_citations(said, found.select("query_id", F.col("pos").alias("ord")))


QUERIES = {
    f.__name__: f
    for f in (
        order_by_page, clean_fragment, format_context, search_and_format, source_annotation, annotated_context,
        format_citation, source_list, assemble_context, merge_citation_pages, cover_field_extract, verify_citations,
    )
}
