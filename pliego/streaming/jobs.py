"""Ingest, chat state and session expiry as Structured Streaming jobs.

Each job reads new files of a folder, keeps its progress in a checkpoint folder and writes Parquet, so a lost executor
or a restart goes on from the last finished batch. ``trigger(availableNow=True)`` works off what is there and stops.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window as W

from pliego import constants as K
from pliego.operators.chunking import chunk_fixed
from pliego.operators.conversation import spoken
from pliego.operators.metadata import enrich
from pliego.sources.tables import SCHEMAS
from pliego.streaming import state_table

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
TURN_BLOCK = 1024
SILENCE_MS = 24 * 3_600_000


def incoming(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of one table, which is a file or a folder of files. The path is a pattern, since a stream takes a
    plain path for a folder."""
    return (
        spark.readStream.schema(SCHEMAS[name])
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name}.parque[t]")
    )


def run_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Append a stream's rows to a Parquet table until the input is used up, and read the table."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def ingest(pages: DataFrame, path: str, processed: str) -> DataFrame:
    """New pages become chunks with metadata and are appended to the store; chunks are numbered per page. A page number
    that comes with the pages is kept; only a missing one is filled in."""
    page = F.col("page").cast("bigint") if "page" in pages.columns else F.lit(None).cast("bigint")
    chunks = chunk_fixed(pages.withColumn("page", page)).withColumnRenamed("pos", "chunk_index")
    return run_to_files(enrich(chunks, F.lit(processed)), path)


def _last_messages(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # what it held is in the written table
        state.remove()
        return
    began, count, tail = state.get if state.exists else (None, 0, "[]")
    seen = 0
    kept = [tuple(m) for m in json.loads(tail)]
    for batch in batches:
        count += len(batch)
        first = int(batch["turn"].min())
        began = first if began is None else began
        seen = max(seen, int(batch["seen"].max().timestamp() * 1000))
        kept = sorted([*kept, *zip(batch["turn"].tolist(), batch["line"].tolist())])[-K.HISTORY_MESSAGES :]
    state.update((began, count, json.dumps(kept)))
    state.setTimeoutTimestamp(seen + SILENCE_MS)
    yield pd.DataFrame({"conv_id": [key[0]], "block": [key[1]], "began": [began], "messages": [count], "tail": [json.dumps(kept)]})


def chat_state(messages: DataFrame, path: str) -> DataFrame:
    """Keep count and last messages per conversation while messages arrive; returns the latest state of each.

    The state's key is (conversation, block of turns), so a very long conversation is spread over many keys, and every
    key holds four messages and a count. Each batch merges its changed states into a table with one row per state (see
    ``state_table``). A state without messages for ``SILENCE_MS`` is dropped; messages after that begin a new one, named by
    its first turn, and the written table, which has both, gives the whole conversation."""
    said = messages.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id",
        F.expr(f"turn div {TURN_BLOCK}").alias("block"),
        "turn",
        spoken(F.col("role"), F.col("text")).alias("line"),
        F.current_timestamp().alias("seen"),
    )
    # messages carry no time of their own, so silence is measured by when they were read
    states = said.withWatermark("seen", "0 seconds").groupBy("conv_id", "block").applyInPandasWithState(
        _last_messages,
        state_table.STATE,
        "began bigint, messages bigint, tail string",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    query = (
        states.writeStream.foreachBatch(lambda batch, number: state_table.merge(batch, number, path))
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merge_states(state_table.load(messages.sparkSession, path))


def merge_states(written: DataFrame) -> DataFrame:
    """(conv_id, messages, history_tail) from all states of a conversation, one row each."""
    counts = written.groupBy("conv_id").agg(F.sum("messages").alias("messages"))
    back = W.partitionBy("conv_id").orderBy(F.col("block").desc(), F.col("began").desc())
    # Four states are enough for four messages: each holds at least one, and later states hold later turns.
    last = written.withColumn("_r", F.row_number().over(back)).filter(F.col("_r") <= K.HISTORY_MESSAGES)
    lines = last.select("conv_id", F.explode(F.from_json("tail", "array<array<string>>")).alias("m")).select(
        "conv_id", F.struct(F.col("m")[0].cast("bigint").alias("turn"), F.col("m")[1].alias("line")).alias("m")
    )
    tails = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("all")).select(
        "conv_id",
        F.array_join(F.transform(F.slice("all", -F.least(F.size("all"), F.lit(K.HISTORY_MESSAGES)), K.HISTORY_MESSAGES),
                                 lambda m: m["line"]), "\n").alias("history_tail"),
    )
    return counts.join(tails, "conv_id")


def expired_sessions(events: DataFrame, path: str, hours: int = K.SESSION_HOURS, late: str = "1 hour") -> DataFrame:
    """Sessions that ended after ``hours`` of silence, once the watermark has passed their end."""
    spark = events.sparkSession
    before = spark.conf.get(LOCAL_MERGE)
    # Rows of one user are merged into sessions in their own partition before the shuffle.
    spark.conf.set(LOCAL_MERGE, "true")
    try:
        sessions = (
            events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
            .withWatermark("ts", late)
            .groupBy("user_id", F.session_window("ts", f"{hours} hours").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(
                "user_id",
                F.col("w.start").cast("timestamp_ntz").alias("first_ts"),
                F.col("w.end").cast("timestamp_ntz").alias("expires_ts"),
                "n_events",
            )
        )
        return run_to_files(sessions, path)
    finally:
        spark.conf.set(LOCAL_MERGE, before)
