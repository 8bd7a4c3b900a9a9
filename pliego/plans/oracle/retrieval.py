"""DuckDB twins of the search, context and citation queries."""

from __future__ import annotations

from pliego import constants as K
from pliego.plans.contexts import MARKUP
from pliego.plans.ingest import PROCESSED
from pliego.plans.oracle import parts as P
from pliego.plans.retrieval import LAMBDAS, NOTHING_ID

ALL_VECTORS = "store_ AS (SELECT vec_id AS chunk_id, embedding, label FROM embeddings)"
INDEX = P.chunk_store(PROCESSED)
EVERY_QUERY = f"(SELECT query_id FROM asked UNION ALL SELECT {NOTHING_ID})"
NAMED = f"""named AS (SELECT doc_id, CASE WHEN length(page_content) >= 300 THEN {P.file_name('source')} END AS file_name,
  CASE WHEN length(page_content) > 5000 THEN 'None' WHEN length(page_content) <= 2000 THEN CAST(page AS VARCHAR) END AS page FROM pages_)"""
ANSWER_LIST = f"text || ' [1][99]' || chr(10) || chr(10) || {P.text(K.SOURCES_MARKER)} || chr(10) || '- Fondo Uno (página 3)' || chr(10) || ' nota' || chr(10) || '  -Fondo Dos ' || chr(10)"
ANSWERS = f"""answers AS (SELECT conv_id, turn, CASE WHEN length(text) < 200 THEN text WHEN length(text) < 1000 THEN {ANSWER_LIST}
  ELSE {ANSWER_LIST} || {P.text(K.SOURCES_MARKER)} || chr(10) || '- Fondo Tres' END AS response FROM conversations WHERE role = 'assistant')"""
PAGE_TEXT = "CAST(page AS VARCHAR)"
COVER = " OR ".join(f"contains(html, {P.text(p)})" for p in K.COVER_IGNORE)


def cover(field: str, pattern: str) -> str:
    return f"""SELECT h.source, '{field}' AS field, coalesce(f.value, {P.text(K.NOT_IN_DOCUMENT)}) AS value
  FROM (SELECT DISTINCT source FROM hosts) h LEFT JOIN (SELECT source, arg_min(regexp_extract(html, '{pattern}', 1), page) AS value FROM hosts
    WHERE page BETWEEN 1 AND 2 AND NOT ({COVER}) AND regexp_extract(html, '{pattern}', 1) <> '' GROUP BY source) f ON f.source = h.source"""


SQL = {
    "knn_chunks": f"""WITH {INDEX}, asked AS (SELECT chunk_id AS query_id, embedding AS query_vec, {K.DEFAULT_K} AS k FROM store_),
{P.nearest('k')} SELECT query_id, rank, chunk_id, distance FROM candidates""",
    "build_vector_store": f"""WITH {INDEX} SELECT chunk_id, source, file_name, page, chunk_index, page_content,
  {P.vector_digest('embedding')} AS vector_digest FROM store_""",
    "knn_exact": f"WITH {ALL_VECTORS}, {P.asked(K.DEFAULT_K)}, {P.nearest()} SELECT query_id, rank, chunk_id, distance FROM candidates",
    "knn_clustered": f"WITH {INDEX}, {P.asked(K.DEFAULT_K)}, {P.nearest()} SELECT query_id, rank, chunk_id, distance FROM candidates",
    "knn_dynamic_k": f"WITH {INDEX}, {P.asked()}, {P.nearest()} SELECT query_id, k, rank, chunk_id, distance FROM candidates",
    "mmr_rerank": f"""WITH RECURSIVE {INDEX}, {P.asked(K.DEFAULT_K)}, {P.nearest()}, {P.mmr()}
SELECT query_id, pos, rank, chunk_id, round(similarity, 6) AS similarity FROM found""",
    "mmr_search_agent": f"WITH RECURSIVE {INDEX}, {P.asked(K.AGENT_K)}, {P.nearest()}, {P.mmr()} SELECT query_id, pos, chunk_id FROM found",
    "search_lambda_sweep": f"""WITH RECURSIVE {INDEX}, {P.asked(K.DEFAULT_K)}, {P.nearest().replace('candidates AS', 'plain AS')},
candidates AS (SELECT p.*, b.lambda_mult FROM plain p CROSS JOIN (SELECT unnest({LAMBDAS}) :: DOUBLE AS lambda_mult) b),
{P.mmr('lambda_mult', ', lambda_mult')},
near AS (SELECT query_id, lambda_mult, avg(similarity) AS relevance FROM found GROUP BY ALL),
alike AS (SELECT a.query_id, a.lambda_mult, avg(list_cosine_similarity(a.vec, b.vec)) AS likeness FROM found a JOIN found b
  ON a.query_id = b.query_id AND a.lambda_mult = b.lambda_mult AND a.pos <> b.pos GROUP BY ALL)
SELECT n.lambda_mult, count(*) AS queries, round(avg(relevance), 6) AS mean_similarity, round(avg(likeness), 6) AS mean_pairwise
FROM near n LEFT JOIN alike a ON a.query_id = n.query_id AND a.lambda_mult = n.lambda_mult GROUP BY n.lambda_mult""",
    "search_empty": f"""WITH RECURSIVE {INDEX}, {P.asked(K.DEFAULT_K)}, {P.nearest()}, {P.mmr()},
n AS (SELECT query_id, count(*) AS n, arg_min(chunk_id, pos) AS first FROM found GROUP BY query_id)
SELECT q.query_id, coalesce(n, 0) AS results, coalesce(CAST(first AS VARCHAR), {P.text(K.NO_RESULTS)}) AS first_result
FROM {EVERY_QUERY} q LEFT JOIN n ON n.query_id = q.query_id""",
    "knn_filtered": f"""WITH {ALL_VECTORS}, {P.asked(5)}, {P.nearest('5', 's.label = q.query_label')}
SELECT query_id, rank, chunk_id, distance FROM candidates""",
    "order_by_page": f"""WITH RECURSIVE {P.searched(K.DEFAULT_K)}, gapped AS (SELECT query_id, pos, chunk_id,
  CASE WHEN length(page_content) < {K.CHUNK_SIZE} THEN page END AS page FROM results)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(page, 999), pos) AS INTEGER) AS ord, pos, chunk_id, page FROM gapped""",
    "clean_fragment": f"SELECT doc_id, {P.one_line('text')} AS content FROM documents",
    "format_context": f"WITH RECURSIVE {P.searched()}, {P.contexts('pos', 'results')} SELECT query_id, context FROM contexts_",
    "search_and_format": f"""WITH RECURSIVE {P.searched(K.DEFAULT_K)}, {P.contexts('pos', 'results')},
ids AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos) AS chunk_ids FROM results GROUP BY query_id)
SELECT c.query_id, context, chunk_ids FROM contexts_ c JOIN ids ON ids.query_id = c.query_id""",
    "source_annotation": f"WITH {P.PAGES}, {NAMED} SELECT doc_id, {P.annotation('file_name', 'page')} AS annotation FROM named",
    "annotated_context": f"""WITH RECURSIVE {P.searched(K.DEFAULT_K)}
SELECT query_id, string_agg('[' || pos || '] ' || page_content || chr(10) || {P.annotation('file_name', PAGE_TEXT)},
  chr(10) || '---' || chr(10) ORDER BY pos) AS context FROM results GROUP BY query_id""",
    "format_citation": f"WITH {P.PAGES}, {NAMED} SELECT doc_id, {P.citation('file_name', 'page')} AS citation FROM named",
    "source_list": f"""WITH RECURSIVE {P.searched(K.DEFAULT_K)}, {P.contexts('pos', 'results')}
SELECT q.query_id, coalesce(source_list, {P.text(K.SOURCES_MARKER)} || chr(10) || '- {K.GENERAL_KNOWLEDGE}') AS source_list
FROM {EVERY_QUERY} q LEFT JOIN contexts_ c ON c.query_id = q.query_id""",
    "assemble_context": f"""WITH RECURSIVE {P.searched(K.AGENT_K)}, {P.ORDERED}, {P.contexts('ord', 'ordered')}
SELECT q.query_id, coalesce(context || chr(10) || chr(10) || source_list, {P.text(K.NO_RESULTS)}) AS context, coalesce(fragments, 0) AS fragments
FROM {EVERY_QUERY} q LEFT JOIN contexts_ c ON c.query_id = q.query_id""",
    "merge_citation_pages": f"""WITH RECURSIVE {P.searched(K.AGENT_K)},
names AS (SELECT DISTINCT query_id, {P.citation_name('file_name')} AS name, page FROM results)
SELECT query_id, '- ' || name || CASE WHEN count(page) = 0 THEN '' WHEN count(page) = 1 THEN ' (página ' || min(page) || ')'
  ELSE ' (páginas ' || string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) || ')' END AS line FROM names GROUP BY query_id, name""",
    "cover_field_extract": f"""WITH hosts AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, html,
  row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS page FROM pages)
{' UNION ALL '.join(cover(f, p) for f, p in MARKUP.items())}""",
    "verify_citations": f"""WITH RECURSIVE {INDEX}, {P.asked(K.DEFAULT_K)}, {P.nearest()}, {P.mmr()}, {ANSWERS},
cited AS (SELECT DISTINCT conv_id AS query_id, turn, regexp_replace(unnest(regexp_extract_all(response, '\\[([0-9]+)\\]', 1)), '^0+([0-9])', '\\1') AS cited FROM answers)
SELECT c.query_id, c.turn, CASE WHEN length(cited) <= 18 THEN CAST(cited AS BIGINT) END AS ord, c.cited, f.pos IS NOT NULL AS supported
FROM cited c LEFT JOIN found f ON f.query_id = c.query_id AND CAST(f.pos AS VARCHAR) = c.cited""",
}
