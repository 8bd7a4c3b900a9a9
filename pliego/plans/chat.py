"""Sessions, histories, requests and answers over the given conversations, and the whole chat path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pliego import constants as K
from pliego.functions.vectors import embed
from pliego.operators import answers, context, conversation as talk
from pliego.operators.nearest import answerable
from pliego.operators.rerank import search
from pliego.plans import ingest
from pliego.plans.retrieval import asked, index, with_unanswerable
from pliego.session import kept
from pliego.sources import tables
from pliego.sources.store import holding

NO_REPLY = "no answer was stored"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chat_messages(spark, sf_dir)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user message as a request with the history it met. A first message without a stored reply stands for a
    request that failed, a later one for a failed model call."""
    sent = talk.replayed(messages(spark, sf_dir))
    failed = F.col("response").isNull() & (F.col("history_len") == 0)
    return sent.withColumns(
        {"error": F.when(failed, F.lit(NO_REPLY)), "response": answers.model_reply(F.col("response"))}
    )


def create_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chat_sessions(spark, sf_dir).select("conv_id", "user_id", "thread_id")


def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.last_state(messages(spark, sf_dir))


def resolve_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that wait for an answer, with the state their thread had before them."""
    said = kept(messages(spark, sf_dir), "messages")
    waiting = kept(talk.open_requests(said), "waiting")
    stored = said.join(waiting.select(F.col("request_id").alias("message_id")), "message_id", "left_anti")
    return talk.resolve_requests(waiting, talk.last_state(stored))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.history_window(messages(spark, sf_dir)).select("thread_id", "seq", "history")


def contextualize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.contextualize(requests(spark, sf_dir)).select("request_id", "search_query", "rewrite_prompt")


def append_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.append_turns(messages(spark, sf_dir))


def no_result_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query finds anything needs no search: a query without results has the fixed answer."""
    found = answerable(with_unanswerable(asked(spark, sf_dir, K.AGENT_K)), index(spark, sf_dir))
    return found.select("query_id", F.when(~F.col("answerable"), F.lit(K.NO_RESULTS_ANSWER)).alias("answer"))


def build_answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over the history as context; the question is the original input, not the rewritten one."""
    prompt = answers.answer_prompt(F.col("history"), F.col("user_input"))
    return requests(spark, sf_dir).select("request_id", prompt.alias("prompt"))


def chat_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes with the history as context, so first requests used no tool."""
    sent = answers.envelope(F.col("response"), F.col("thread_id"), F.col("history"), F.col("error"))
    return requests(spark, sf_dir).select("request_id", sent.alias("envelope"))


def parse_response_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = answers.parse_answers(tables.answers(spark, sf_dir))
    return parsed.select("conv_id", "turn", "answer", F.array_join("sources", "|").alias("sources"), "general_knowledge")


def render_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.transcript_lines(messages(spark, sf_dir))


def history_limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.newest_messages(messages(spark, sf_dir), 3).select("thread_id", "pos", "seq", "role", "content")


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.sessions_by_silence(tables.read(spark, sf_dir, "events").select("user_id", "ts")).select(
        "user_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', first_ts)").alias("first_us"),
        F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', last_ts + interval {K.SESSION_HOURS} hours)").alias("expires_us"),
        "n_events",
    )


def user_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talk.user_threads(tables.chat_sessions(spark, sf_dir), messages(spark, sf_dir))


def run_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests through the whole path: state, search text, search in the ingested store, context, prompt and
    envelope. The stored answers stand in for the model's."""
    sent = kept(talk.contextualize(requests(spark, sf_dir)).withColumnRenamed("request_id", "query_id"), "requests")
    queries = sent.select("query_id", embed(F.col("search_query")).alias("query_vec"), F.lit(K.AGENT_K).alias("k"))
    stored = ingest.saved_store(spark, sf_dir)
    found = kept(search(kept(queries, "query-vectors"), stored.select("chunk_id", "embedding")), "found")
    shown = holding(stored.select("chunk_id", "file_name", "page", "page_content"), found).join(found, "chunk_id")
    full = context.assemble(queries, shown).join(sent, "query_id")
    reply = F.coalesce(answers.fixed_answer(F.col("context")), F.col("response"))
    return full.select(
        F.col("query_id").alias("request_id"),
        "thread_id",
        "history_len",
        "fragments",
        answers.answer_prompt(F.col("context"), F.col("user_input")).alias("prompt"),
        answers.envelope(reply, F.col("thread_id"), F.col("context"), F.col("error")).alias("envelope"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        create_session, last_state, resolve_request, history_window, contextualize_query, append_turn, no_result_answer,
        build_answer_prompt, chat_response, parse_response_sources, render_history, history_limit_n, session_expiry,
        user_threads, run_chat,
    )
}
