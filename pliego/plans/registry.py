"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from pliego.plans import chat, contexts, ingest, retrieval, streams
from pliego.plans.oracle import chat as chat_sql
from pliego.plans.oracle import ingest as ingest_sql
from pliego.plans.oracle import retrieval as retrieval_sql

QUERIES = {**ingest.QUERIES, **retrieval.QUERIES, **contexts.QUERIES, **chat.QUERIES, **streams.QUERIES}
SQL = {**ingest_sql.SQL, **retrieval_sql.SQL, **chat_sql.SQL}
