"""The given tables, read as page documents, chat messages, vectors, answers and file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pliego import constants as K
from pliego.operators.conversation import create_sessions
from pliego.operators.ordering import DENSE_SPAN, row_index, running_totals

# Fixed value: the file behind source 'src7' has a name longer than 50 characters.
LONG_NAME_SOURCE, LONG_NAME = "src7", "historico_de_la_universidad_y_sus_facultades_"


# Known schemas: reading starts without a look into the files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a scan that has fewer splits than the cluster has cores, dealt out by key.

    A large table has more splits than that and stays as it is; a small one would run its per-row work in few tasks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def document_path(source: Column, lang: Column) -> Column:
    longer = F.when(source == LONG_NAME_SOURCE, F.lit(LONG_NAME)).otherwise(F.lit(""))
    return F.concat(F.lit("./data/fondo_"), longer, source, F.lit("_"), lang, F.lit(".pdf"))


def as_pages(documents: DataFrame) -> DataFrame:
    """One page document per row, not numbered yet; one file per source and language."""
    return documents.select(
        document_path(F.col("source"), F.col("lang")).alias("source"),
        "doc_id",
        "lang",
        F.col("text").alias("page_content"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pages(spread(read(spark, sf_dir, "documents"), "doc_id"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, conv_id, thread_id, message_id, seq, role, content) of every user and assistant message; ``message_id``
    numbers the messages of all conversations."""
    said = (
        read(spark, sf_dir, "conversations")
        .filter(F.col("role").isin("user", "assistant"))
        .select("conv_id", "turn", "role", F.col("text").alias("content"))
    )
    return row_index(said, ["conv_id"], "turn", "seq", DENSE_SPAN, chat_sessions(spark, sf_dir)).select(
        "user_id", "conv_id", "thread_id", (F.col("first_message") + F.col("seq")).alias("message_id"), "seq", "role", "content"
    )


def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, first_message, user_id, thread_id): each conversation is one session of one of seven users;
    ``first_message`` is the number of messages in the conversations before it."""
    said = F.count(F.when(F.col("role").isin("user", "assistant"), F.lit(1)))
    talks = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("n"))
    talks = running_totals(talks, [], "conv_id", {"first_message": F.col("n")}).select("conv_id", "first_message")
    return create_sessions(talks.withColumn("user_id", F.col("conv_id") % 7), "user_id", "conv_id")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant texts in the three shapes an answer may have: no source list, one list, a second marker."""
    said = read(spark, sf_dir, "conversations").filter("role = 'assistant'")
    one = F.concat(F.col("text"), F.lit(f" [1][99]\n\n{K.SOURCES_MARKER}\n- Fondo Uno (página 3)\n nota\n  -Fondo Dos \n"))
    two = F.concat(one, F.lit(f"{K.SOURCES_MARKER}\n- Fondo Tres"))
    size = F.length("text")
    return said.select(
        "conv_id", "turn", F.when(size < 200, F.col("text")).when(size < 1000, one).otherwise(two).alias("response")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every given vector as a query with its own k, from 5 to 32, so that both branches of fetch_k occur."""
    return vectors(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").alias("query_vec"),
        (F.lit(5) + 3 * F.col("label")).cast("int").alias("k"),
        F.col("label").alias("query_label"),
    )
