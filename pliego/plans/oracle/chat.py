"""DuckDB twins of the conversation, chat and streaming queries."""

from __future__ import annotations

from pliego import constants as K
from pliego.operators.conversation import DIGEST_PRIME
from pliego.plans.chat import NO_REPLY
from pliego.plans.ingest import PROCESSED
from pliego.plans.oracle import parts as P
from pliego.plans.oracle.retrieval import ANSWERS, EVERY_QUERY

SESSIONS = """sessions AS (SELECT conv_id, conv_id % 7 AS user_id, 'user_' || (conv_id % 7) || '_' ||
  (row_number() OVER (PARTITION BY conv_id % 7 ORDER BY conv_id) - 1) AS thread_id FROM (SELECT DISTINCT conv_id FROM conversations) x)"""
MESSAGES = f"""{SESSIONS}, messages AS (SELECT s.user_id, c.conv_id, s.thread_id, row_number() OVER (ORDER BY c.conv_id, turn) - 1 AS message_id,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) - 1 AS seq, role, text AS content, CASE WHEN role = 'user' THEN 'User: ' ELSE 'AI: ' END || text AS line
  FROM conversations c JOIN sessions s ON s.conv_id = c.conv_id WHERE role IN ('user', 'assistant'))"""
HISTORY = f"""{MESSAGES}, histories AS (SELECT m.thread_id, m.conv_id, m.message_id, m.seq, m.role, m.content,
  coalesce(string_agg(h.line, chr(10) ORDER BY h.seq), '') AS history FROM messages m
  LEFT JOIN messages h ON h.thread_id = m.thread_id AND h.seq BETWEEN m.seq - 4 AND m.seq - 1 GROUP BY ALL)"""
REQUESTS = f"""{HISTORY}, requests AS (SELECT message_id AS request_id, conv_id, thread_id, content AS user_input, CAST(seq AS BIGINT) AS history_len, history FROM histories WHERE role = 'user'),
replies AS (SELECT r.*, coalesce({P.strip('m.content')}, {P.text(K.MODEL_ERROR)}) AS response, CASE WHEN m.content IS NULL AND history_len = 0 THEN '{NO_REPLY}' END AS error
  FROM requests r LEFT JOIN messages m ON m.conv_id = r.conv_id AND m.seq = r.history_len + 1 AND m.role = 'assistant')"""
SEARCH_QUERY = "CASE WHEN history = '' THEN user_input ELSE history || chr(10) || user_input END"
TURNS = f"""turns AS (SELECT u.thread_id, row_number() OVER (PARTITION BY u.thread_id ORDER BY u.seq) - 1 AS turn_no, u.content AS user_message, a.content AS assistant_message
  FROM messages u JOIN messages a ON a.thread_id = u.thread_id AND a.seq = u.seq + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
def message_term(role: str, column: str, place: int) -> str:
    """The digest of a message times its place in the history, modulo a prime."""
    digest = P.md5_number(f"'{role}|' || {column}", 7)
    return f"({digest} * ((2 * turn_no + {place}) % {DIGEST_PRIME}) % {DIGEST_PRIME})"


MESSAGE_SUM = f"({message_term('user', 'user_message', 1)} + {message_term('assistant', 'assistant_message', 2)})"


def envelope(response: str, context: str) -> str:
    return f"""CAST(CASE WHEN error IS NULL THEN json_object('status', 'success', 'response', {response}, 'thread_id', thread_id,
  'agent_used_tool', coalesce({context}, '') <> '') ELSE json_object('status', 'error', 'response', {P.text(K.SERVER_ERROR)},
  'thread_id', thread_id, 'error_detail', error) END AS VARCHAR)"""


PARSED = f"""parsed AS (SELECT conv_id, turn, {P.strip(f"split_part(response, {P.text(K.SOURCES_MARKER)}, 1)", K.BROWSER_BLANKS)} AS answer,
  {P.strip(f"split_part(response, {P.text(K.SOURCES_MARKER)}, 2)", K.BROWSER_BLANKS)} AS listed FROM answers)"""
LINES = f"list_filter(list_transform(string_split(listed, chr(10)), lambda s: {P.strip('s', K.BROWSER_BLANKS)}), lambda s: starts_with(s, '-'))"
GAPS = f"""steps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {K.SESSION_HOURS} HOURS THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
marked AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM steps),
spans AS (SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts) + INTERVAL {K.SESSION_HOURS} HOURS) AS expires_us,
  count(*) AS n_events FROM marked GROUP BY user_id, no)"""

SQL = {
    "create_session": f"WITH {SESSIONS} SELECT conv_id, user_id, thread_id FROM sessions",
    "last_state": f"""WITH {MESSAGES}, sizes AS (SELECT thread_id, count(*) AS history_len FROM messages GROUP BY thread_id)
SELECT m.thread_id, history_len, arg_max(content, seq) FILTER (WHERE role = 'user') AS input,
  arg_max(content, seq) FILTER (WHERE role = 'assistant') AS answer,
  string_agg(line, chr(10) ORDER BY seq) FILTER (WHERE seq >= history_len - 4) AS history_tail
FROM messages m JOIN sizes s ON s.thread_id = m.thread_id GROUP BY m.thread_id, history_len""",
    "resolve_request": f"""WITH {HISTORY}, waiting AS (SELECT * FROM histories h WHERE role = 'user' AND seq =
  (SELECT max(seq) FROM messages m WHERE m.thread_id = h.thread_id))
SELECT message_id AS request_id, CASE WHEN seq = 0 THEN 'user_{K.DEFAULT_USER}_' ||
  (row_number() OVER (PARTITION BY seq = 0 ORDER BY conv_id) - 1) ELSE thread_id END AS thread_id, content AS user_input,
  CAST(seq AS BIGINT) AS history_len, history FROM waiting""",
    "history_window": f"WITH {HISTORY} SELECT thread_id, seq, history FROM histories",
    "contextualize_query": f"""WITH {REQUESTS} SELECT request_id, {SEARCH_QUERY} AS search_query,
  CASE WHEN history <> '' THEN {P.filled(K.REWRITE_PROMPT, history='history', input='user_input')} END AS rewrite_prompt FROM requests""",
    "append_turn": f"""WITH {MESSAGES}, {TURNS} SELECT thread_id, CAST(turn_no AS BIGINT) AS turn_no, user_message, assistant_message,
  2 * count(*) OVER w AS history_len, CAST(sum({MESSAGE_SUM}) OVER w AS BIGINT) AS history_digest
FROM turns WINDOW w AS (PARTITION BY thread_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING)""",
    "no_result_answer": f"""WITH asked AS (SELECT vec_id AS query_id FROM embeddings),
found AS (SELECT query_id, count(*) AS n FROM asked q CROSS JOIN (SELECT doc_id FROM documents LIMIT 1) s GROUP BY query_id)
SELECT q.query_id, CASE WHEN n IS NULL THEN {P.text(K.NO_RESULTS_ANSWER)} END AS answer
FROM {EVERY_QUERY} q LEFT JOIN found f ON f.query_id = q.query_id""",
    "build_answer_prompt": f"WITH {REQUESTS} SELECT request_id, {P.filled(K.ANSWER_PROMPT, context='history', input='user_input')} AS prompt FROM requests",
    "chat_response": f"WITH {REQUESTS} SELECT request_id, {envelope('response', 'history')} AS envelope FROM replies",
    "parse_response_sources": f"""WITH {ANSWERS}, {PARSED} SELECT conv_id, turn, answer,
  array_to_string(list_transform({LINES}, lambda s: {P.strip('substr(s, 2)', K.BROWSER_BLANKS)}), '|') AS sources,
  listed = '' AS general_knowledge FROM parsed""",
    "render_history": f"""WITH {MESSAGES}, lines AS (SELECT thread_id, seq, role || ': ' || content || chr(10) AS line FROM messages),
whole AS (SELECT thread_id, string_agg(line, '' ORDER BY seq) AS transcript FROM lines GROUP BY thread_id),
ends AS (SELECT thread_id, seq, line, CAST(sum(length(line)) OVER (PARTITION BY thread_id ORDER BY seq) AS BIGINT) AS stop FROM lines)
SELECT e.thread_id, seq, substr(transcript, stop - length(line) + 1, length(line)) AS line, stop - length(line) AS char_start,
  length(transcript) AS transcript_chars FROM ends e JOIN whole w ON w.thread_id = e.thread_id""",
    "history_limit_n": f"""WITH {MESSAGES}, newest AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS back FROM messages)
SELECT thread_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS INTEGER) AS pos, seq, role, content FROM newest WHERE back <= 3""",
    "session_expiry": f"WITH {GAPS} SELECT user_id, first_us, expires_us, n_events FROM spans",
    "user_threads": f"""WITH {MESSAGES}, owners AS (SELECT thread_id, count(DISTINCT user_id) AS owners FROM messages GROUP BY thread_id)
SELECT m.user_id, count(DISTINCT m.thread_id) AS threads, count(*) AS messages,
  count(DISTINCT CASE WHEN owners > 1 THEN m.thread_id END) AS shared_threads
FROM messages m JOIN owners o ON o.thread_id = m.thread_id GROUP BY m.user_id""",
    "run_chat": f"""WITH RECURSIVE {P.chunk_store(PROCESSED)}, {REQUESTS},
texts AS (SELECT request_id, {SEARCH_QUERY} AS search_query FROM replies), {P.embedded('texts', 'request_id', 'search_query', 'query_vectors')},
asked AS (SELECT request_id AS query_id, embedding AS query_vec, {K.AGENT_K} AS k FROM query_vectors),
{P.nearest(condition='true')}, {P.mmr()}, {P.RESULTS}, {P.ORDERED}, {P.contexts('ord', 'ordered').replace('texts AS', 'joined AS').replace('FROM texts t', 'FROM joined t')},
full_ AS (SELECT r.*, coalesce(c.fragments, 0) AS fragments, coalesce(c.context || chr(10) || chr(10) || c.source_list, {P.text(K.NO_RESULTS)}) AS context
  FROM replies r LEFT JOIN contexts_ c ON c.query_id = r.request_id)
SELECT request_id, thread_id, history_len, fragments, {P.filled(K.ANSWER_PROMPT, context='context', input='user_input')} AS prompt,
  {envelope(f"CASE WHEN context = {P.text(K.NO_RESULTS)} THEN {P.text(K.NO_RESULTS_ANSWER)} ELSE response END", 'context')} AS envelope FROM full_""",
    "stream_ingest": f"""WITH {P.RAW_PAGES}, cut_ AS ({P.cut('doc_id, source', 'raw_pages')}) SELECT doc_id, source, {P.file_name('source')} AS file_name,
  CAST(0 AS BIGINT) AS page, pos AS chunk_index, '{PROCESSED}' AS processed_date, page_content FROM cut_""",
    "stream_chat_state": f"""WITH {MESSAGES}, sizes AS (SELECT conv_id, count(*) AS messages FROM messages GROUP BY conv_id)
SELECT m.conv_id, messages, string_agg(line, chr(10) ORDER BY seq) AS history_tail FROM messages m JOIN sizes s ON s.conv_id = m.conv_id
WHERE seq >= messages - 4 GROUP BY m.conv_id, messages""",
    "stream_session_expiry": f"""WITH {GAPS} SELECT user_id, first_us, expires_us, n_events FROM spans
WHERE expires_us <= (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) FROM events)""",
}
