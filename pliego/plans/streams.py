"""The streaming jobs over the given tables, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pliego.plans.ingest import PROCESSED
from pliego.session import shared_folder
from pliego.sources import tables
from pliego.streaming import jobs


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.as_pages(jobs.incoming(spark, sf_dir, "documents"))
    stored = jobs.ingest(pages, shared_folder(spark, "stream-store"), PROCESSED)
    return stored.select("doc_id", "source", "file_name", "page", "chunk_index", "processed_date", "page_content")


def stream_chat_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.chat_state(jobs.incoming(spark, sf_dir, "conversations"), shared_folder(spark, "chat-state"))


def stream_session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ended = jobs.expired_sessions(jobs.incoming(spark, sf_dir, "events"), shared_folder(spark, "sessions"))
    return ended.select(
        "user_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', first_ts)").alias("first_us"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', expires_ts)").alias("expires_us"),
        "n_events",
    )


QUERIES = {f.__name__: f for f in (stream_ingest, stream_chat_state, stream_session_expiry)}
