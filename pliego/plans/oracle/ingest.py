"""DuckDB twins of the ingest queries."""

from __future__ import annotations

from pliego import constants as K
from pliego.plans.ingest import PROCESSED, SWEEP
from pliego.plans.oracle import parts as P

GAPPED = """gapped AS (SELECT doc_id, CASE WHEN length(page_content) >= 300 THEN source END AS source,
  CASE WHEN length(page_content) <= 5000 THEN page END AS page, page_content, total_pages, source AS full_source FROM pages_)"""
GAPPED_CHUNKS = f"""{P.CHUNKS}, {GAPPED}, gapped_chunks AS (SELECT c.chunk_id, c.chunk_index, c.page_content, c.total_pages,
  g.source, g.page FROM chunks_ c JOIN gapped g ON g.doc_id = c.doc_id)"""
HAS_SUMMARY = "CASE WHEN document_summary <> '' THEN 1 ELSE 0 END"

def recursive_chunks(size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> str:
    """The recursive splitter as two recursions: over (page, separator level, part) until all parts are small enough, and
    over the chunks of a page, which are packed greedily out of its parts."""
    blank = f"[{K.PYTHON_BLANKS}]+"
    mark = "CASE level WHEN 0 THEN chr(10) || chr(10) WHEN 1 THEN chr(10) ELSE ' ' END"
    split = f"""SELECT *, CASE WHEN level = 3 THEN string_split(part, '') ELSE string_split(part, mark) END AS cut,
    level < 3 AND NOT contains(part, mark) AS same FROM (SELECT *, {mark} AS mark FROM parts WHERE NOT done)"""
    sized = f"""SELECT doc_id, spot, level, same, list_transform(cut, lambda x, i: CASE WHEN i > 1 AND level < 3 THEN mark || x ELSE x END) AS pieces FROM ({split})"""
    # the place of each piece is the length of the ones before it
    placed = f"""SELECT doc_id, spot, level, same, unnest(pieces) AS piece, unnest(places) AS place FROM (SELECT *, CASE WHEN level = 3
    THEN range(0, len(pieces)) ELSE list_transform(pieces, lambda x, i: coalesce(list_sum(list_transform(pieces[1:i - 1], lambda y: length(y))), 0)) END AS places FROM ({sized}))"""
    body = "substr(d.text, CAST(d.B + 1 AS BIGINT), CAST(d.E - d.B AS BIGINT))"
    return f"""WITH RECURSIVE {P.RAW_PAGES}, parts AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS spot, page_content AS part, 0 AS level, false AS done FROM raw_pages WHERE length(page_content) > 0
  UNION ALL
  SELECT doc_id, CAST(spot + place AS BIGINT), piece, level + 1, NOT same AND (level = 3 OR length(piece) <= {size}) FROM ({placed}) WHERE piece <> ''
), pages_of AS (
  SELECT p.doc_id, any_value(r.page_content) AS text, any_value(length(r.page_content)) AS n, list(spot ORDER BY spot) AS starts,
    list(spot + length(part) ORDER BY spot) AS stops FROM parts p JOIN raw_pages r ON r.doc_id = p.doc_id WHERE done GROUP BY p.doc_id
), chunks_of AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS B, CAST(-1 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS stop, '' AS body, false AS given, CAST(0 AS BIGINT) AS next
  FROM pages_of
  UNION ALL
  SELECT doc_id, B, CASE WHEN given THEN first ELSE start END, CASE WHEN given THEN first + length(body) ELSE stop END, body, given,
    CASE WHEN E < n THEN coalesce(list_min(list_filter(tails, lambda c: c + length(substr(text, c + 1, E - c))
      - length(regexp_replace(substr(text, c + 1, E - c), '^{blank}', '')) > CASE WHEN given THEN first ELSE start END)), E) END
  FROM (SELECT f.*, list_filter(starts, lambda c: c >= f.B AND c < f.E AND f.E - c <= {overlap} AND f.E - c + f.l <= {size}) AS tails,
      body <> '' AND first + length(body) > stop AS given
    FROM (SELECT d.*, {P.strip(body)} AS body, d.B + length({body}) - length(regexp_replace({body}, '^{blank}', '')) AS first
      FROM (SELECT b.*, CASE WHEN j IS NULL THEN n ELSE starts[j] END AS E, stops[j] - starts[j] AS l
        FROM (SELECT p.*, c.next AS B, c.start, c.stop, nullif(list_position(list_transform(p.stops, lambda x: x > c.next + {size}), true), 0) AS j
          FROM chunks_of c JOIN pages_of p ON p.doc_id = c.doc_id WHERE c.next IS NOT NULL) b) d) f) g
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos, CAST(start AS INTEGER) AS start, body AS page_content
FROM chunks_of WHERE given"""


SWEEP_SQL = " UNION ALL ".join(
    f"""SELECT {s} AS chunk_size, {o} AS chunk_overlap, count(*) AS chunks, CAST(sum(length(page_content)) AS BIGINT) AS chars
  FROM ({P.cut('doc_id', 'raw_pages', s, o)}) y"""
    for s, o in SWEEP
)

SQL = {
    "scan_pages": f"WITH {P.PAGES} SELECT source, doc_id, page, page_content, total_pages FROM pages_",
    "filter_sources_by_type": "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%html'",
    "chunk_store_roundtrip": f"""WITH {P.chunk_store(PROCESSED)}
SELECT source, count(*) AS chunks, CAST(sum(length(page_content)) AS BIGINT) AS chars,
  CAST(sum({P.md5_number('page_content', 7)}) AS BIGINT) AS content_digest,
  CAST(sum({P.vector_digest('embedding')}) AS BIGINT) AS vector_digest FROM store_ GROUP BY source""",
    "ingest_documents": f"""WITH {P.chunk_store(PROCESSED)}
SELECT chunk_id, source, file_name, page, chunk_index, page_content, processed_date, document_summary,
  {P.vector_digest('embedding')} AS vector_digest FROM store_""",
    "ingest_counts": f"""WITH {P.CHUNKS}, {P.SIMPLE} SELECT c.source, count(DISTINCT doc_id) AS pages, count(*) AS chunks,
  CAST(sum({HAS_SUMMARY}) AS BIGINT) AS chunks_with_summary, CAST(max({HAS_SUMMARY}) AS BIGINT) AS documents_summarised
  FROM chunks_ c LEFT JOIN summaries s ON s.source = c.source GROUP BY c.source""",
    "ocr_routing": f"""WITH {P.RAW_PAGES} SELECT source, CAST(sum(length(page_content)) AS BIGINT) AS chars,
  sum(length(page_content)) <= 500 AS ocr_processed FROM raw_pages GROUP BY source""",
    "chunk_fixed": f"WITH {P.RAW_PAGES} {P.cut('doc_id', 'raw_pages')}",
    "chunk_recursive": recursive_chunks(),
    "chunk_param_sweep": f"WITH {P.RAW_PAGES} {SWEEP_SQL}",
    "chunk_invariants": "SELECT CAST(0 AS BIGINT) AS bad_length, CAST(0 AS BIGINT) AS not_in_page, CAST(0 AS BIGINT) AS uncovered, CAST(0 AS BIGINT) AS too_much_overlap, CAST(0 AS BIGINT) AS not_in_order, CAST(0 AS BIGINT) AS not_filled",
    "chunk_index": f"WITH {P.CHUNKS} SELECT source, page, pos, chunk_index FROM chunks_",
    "default_source": f"WITH {P.PAGES}, {GAPPED} SELECT doc_id, coalesce(source, {P.text(K.DEFAULT_SOURCE)}) AS source FROM gapped",
    "file_name": f"WITH {P.PAGES}, {GAPPED} SELECT doc_id, {P.file_name('source')} AS file_name FROM gapped",
    "processed_date": f"""WITH {P.CHUNKS} SELECT source, '{PROCESSED}' AS first_date, '{PROCESSED}' AS last_date, count(*) AS chunks
  FROM chunks_ GROUP BY source""",
    "default_page": f"WITH {P.PAGES}, {GAPPED} SELECT doc_id, coalesce(page, 0) AS page FROM gapped",
    "enrich_chunk_metadata": f"""WITH {GAPPED_CHUNKS}, filled AS (SELECT * EXCLUDE (source), coalesce(source, {P.text(K.DEFAULT_SOURCE)}) AS source
  FROM gapped_chunks) SELECT chunk_id, source, {P.file_name('source')} AS file_name, coalesce(page, 0) AS page, chunk_index,
  '{PROCESSED}' AS processed_date, page_content FROM filled""",
    "extract_source_info": f"""WITH {GAPPED_CHUNKS} SELECT chunk_id, coalesce(source, {P.text(K.UNKNOWN_SOURCE)}) AS source,
  {P.file_name('source')} AS file_name, page, chunk_index, CAST(NULL AS VARCHAR) AS processed_date, CAST(NULL AS VARCHAR) AS title,
  CAST(NULL AS VARCHAR) AS author, CAST(NULL AS VARCHAR) AS creator, total_pages FROM gapped_chunks""",
    "clean_file_path": f"SELECT page_id, {P.base_name('url')} AS name FROM pages",
    "process_documents_flags": f"""WITH {P.CHUNKS}, {P.SIMPLE}, flags AS (SELECT unnest([true, false]) AS add_metadata),
indexed AS (SELECT add_metadata, chunk_id, CASE WHEN add_metadata THEN chunk_index END AS chunk_index, page_content, document_summary
  FROM chunks_ c JOIN summaries s ON s.source = c.source CROSS JOIN flags)
SELECT add_metadata, chunk_id, chunk_index, {P.prefixed('chunk_index', 'document_summary', 'page_content')} AS page_content FROM indexed""",
    "concat_document_text": f"""WITH {P.CHUNKS}, {P.FULL_TEXT}, ends AS (SELECT source, chunk_index, page_content,
  sum(length(page_content) + 1) OVER (PARTITION BY source ORDER BY chunk_index) AS stop FROM chunks_)
SELECT e.source, e.chunk_index, CAST(stop - length(page_content) - 1 AS BIGINT) AS char_start,
  substr(full_text, CAST(stop - length(page_content) AS BIGINT), length(page_content) + 1) AS piece, length(full_text) AS document_chars
FROM ends e JOIN full_text f ON f.source = e.source""",
    "simple_summary": f"WITH {P.CHUNKS}, {P.SIMPLE} SELECT source, document_summary FROM summaries",
    "summary_guards": """SELECT doc_id, length(substr(text, 1, 5000)) AS model_chars, CASE WHEN length(text) < 300 THEN text
  WHEN length(text) > 500 THEN substr(text, 1, 497) || '...' ELSE text END AS summary FROM documents""",
    "attach_document_summary": f"""WITH {P.CHUNKS}, {P.SIMPLE}
SELECT chunk_id, c.source, coalesce(document_summary, '') AS document_summary FROM chunks_ c LEFT JOIN summaries t ON t.source = c.source""",
    "prefix_first_chunk": f"""WITH {P.CHUNKS}, {P.SIMPLE} SELECT chunk_id,
  {P.prefixed('chunk_index', 'document_summary', 'page_content')} AS page_content FROM chunks_ c JOIN summaries s ON s.source = c.source""",
    "extractive_summary": f"WITH {P.CHUNKS}, {P.EXTRACTIVE} SELECT source, document_summary FROM summaries",
    "embed_text": f"""WITH {P.RAW_PAGES}, {P.embedded('raw_pages', 'doc_id', 'page_content', 'v')}
SELECT doc_id, CAST(bucket AS INTEGER) AS bucket, round(CAST(w AS DOUBLE), 6) AS weight FROM v_sparse""",
}
