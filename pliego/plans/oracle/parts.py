"""Pieces shared by the DuckDB queries: each is one or more common table expressions."""

from __future__ import annotations

from pliego import constants as K
from pliego.plans.ingest import PROCESSED
from pliego.sources.tables import LONG_NAME, LONG_NAME_SOURCE


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    parts, rest = [], template
    for name, value in values.items():
        before, rest = rest.split("{" + name + "}", 1)
        parts += [text(before), value]
    return " || ".join([*parts, text(rest)])


def strip(x: str, blanks: str = K.PYTHON_BLANKS) -> str:
    return f"regexp_replace({x}, '^[{blanks}]+|[{blanks}]+$', '', 'g')"


def one_line(x: str) -> str:
    return strip(f"replace({x}, chr(10), ' ')")


def base_name(x: str) -> str:
    return f"split_part({x}, '/', -1)"


def file_name(x: str) -> str:
    base = base_name(x)
    return (
        f"CASE WHEN coalesce({x}, '') = '' THEN {text(K.UNNAMED_DOCUMENT)} "
        f"WHEN length({base}) > 50 THEN substr({base}, 1, 47) || '...' ELSE {base} END"
    )


def citation_name(x: str) -> str:
    words = f"string_split(replace(replace({x}, '.pdf', ''), '.txt', ''), '_')"
    shown = f"array_to_string(list_transform({words}, lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
    return f"CASE WHEN coalesce({x}, '') IN ('', {text(K.UNKNOWN_DOCUMENT)}) THEN {text(K.UNKNOWN_DOCUMENT)} ELSE {shown} END"


def page_known(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS VARCHAR) <> 'None')"


def citation(name: str, page: str) -> str:
    return f"({citation_name(name)}) || CASE WHEN {page_known(page)} THEN ' (página ' || {page} || ')' ELSE '' END"


def annotation(name: str, page: str) -> str:
    return f"'[Fuente: ' || coalesce({name}, 'None') || CASE WHEN {page_known(page)} THEN ', página ' || {page} ELSE '' END || ']'"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{K.TOKEN_BREAK}'), lambda t: t <> '')"


def md5_number(x: str, digits: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({x}), 1, {digits}) AS BIGINT) AS BIGINT)"


def bucket(x: str) -> str:
    return f"({md5_number(x, 8)} % {K.VECTOR_BUCKETS})"


def vector_digest(x: str) -> str:
    return f"CAST(list_sum(list_transform({x}, lambda v, i: CAST(round(CAST(v AS DOUBLE) * 1000) AS BIGINT) * i)) AS BIGINT)"


SOURCE = (
    f"'./data/fondo_' || CASE WHEN source = '{LONG_NAME_SOURCE}' THEN '{LONG_NAME}' ELSE '' END "
    "|| source || '_' || lang || '.pdf'"
)

RAW_PAGES = f"raw_pages AS (SELECT {SOURCE} AS source, doc_id, lang, text AS page_content FROM documents)"

PAGES = (
    RAW_PAGES
    + """, pages_ AS (SELECT source, doc_id, lang, page_content,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page,
  count(*) OVER (PARTITION BY source) AS total_pages FROM raw_pages)"""
)


def cut(columns: str, origin: str, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP) -> str:
    """Rows of ``origin`` cut into windows; adds pos and page_content."""
    step = size - overlap
    return f"""SELECT {columns}, CAST(i AS INTEGER) AS pos, substr(page_content, CAST(i * {step} + 1 AS BIGINT), {size}) AS page_content
  FROM (SELECT *, unnest(range(0, greatest(0, CAST(ceil((length(page_content) - {size}) / {step}.0) AS BIGINT)) + 1)) AS i FROM {origin}) x"""


CHUNKS = (
    PAGES
    + f""", cut_ AS ({cut("source, doc_id, page, total_pages", "pages_")}),
chunks_ AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY page, pos) - 1 AS chunk_index,
  row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id FROM cut_)"""
)

FULL_TEXT = "full_text AS (SELECT source, string_agg(page_content, chr(10) ORDER BY chunk_index) AS full_text FROM chunks_ GROUP BY source)"

SIMPLE = (
    FULL_TEXT
    + """, summaries AS (SELECT source, CASE WHEN length(full_text) > 500 THEN substr(full_text, 1, 500) || '...' ELSE full_text END
  AS document_summary FROM full_text)"""
)

EXTRACTIVE = (
    FULL_TEXT
    + f""", sentences_raw AS (SELECT source, generate_subscripts(s, 1) AS no, unnest(s) AS raw
  FROM (SELECT source, regexp_split_to_array(substr(full_text, 1, 5000), '[.\\n]') AS s FROM full_text) x),
sentences AS (SELECT source, no, {strip('raw')} AS sentence FROM sentences_raw WHERE {strip('raw')} <> ''),
words AS (SELECT source, no, unnest({tokens('sentence')}) AS token FROM sentences),
tf AS (SELECT source, token, count(*) AS tf FROM words GROUP BY source, token),
scores AS (SELECT w.source, w.no, sum(tf.tf) / count(*) AS score FROM words w JOIN tf ON tf.source = w.source AND tf.token = w.token
  GROUP BY w.source, w.no),
budget AS (SELECT s.source, s.no, s.sentence, sum(length(s.sentence) + 2) OVER (PARTITION BY s.source ORDER BY c.score DESC, s.no
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM sentences s JOIN scores c ON c.source = s.source AND c.no = s.no),
chosen AS (SELECT source, string_agg(sentence, '. ' ORDER BY no) AS proposed FROM budget WHERE used <= 502 GROUP BY source),
proposals AS (SELECT f.source, full_text, coalesce(proposed, CASE WHEN length(full_text) > 500 THEN substr(full_text, 1, 500) || '...'
  ELSE full_text END) AS proposed FROM full_text f LEFT JOIN chosen c ON c.source = f.source),
summaries AS (SELECT source, CASE WHEN length(full_text) < 300 THEN full_text WHEN length(proposed) > 500
  THEN substr(proposed, 1, 497) || '...' ELSE proposed END AS document_summary FROM proposals)"""
)


def prefixed(index: str, summary: str, content: str) -> str:
    return (
        f"CASE WHEN coalesce({index}, 0) = 0 THEN {text(K.SUMMARY_HEADING)} || chr(10) || {summary} || chr(10) || chr(10) || "
        f"{text(K.FIRST_CHUNK_HEADING)} || chr(10) || {content} ELSE {content} END"
    )


def embedded(origin: str, key: str, content: str, name: str) -> str:
    """CTEs that end in ``name``(key, embedding): hashed token counts as FLOAT vectors of length 1."""
    return f"""{name}_words AS (SELECT {key}, unnest({tokens(content)}) AS token FROM {origin}),
{name}_counts AS (SELECT {key}, {bucket('token')} AS bucket, count(*) AS n FROM {name}_words GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(sum(n * n)) AS norm FROM {name}_counts GROUP BY {key}),
{name}_sparse AS (SELECT c.{key}, c.bucket, CAST(c.n / m.norm AS FLOAT) AS w FROM {name}_counts c JOIN {name}_norms m ON m.{key} = c.{key}),
{name} AS (SELECT k.{key}, list(coalesce(s.w, CAST(0 AS FLOAT)) ORDER BY b.bucket) AS embedding
  FROM (SELECT {key} FROM {origin}) k CROSS JOIN (SELECT unnest(range({K.VECTOR_BUCKETS})) AS bucket) b
  LEFT JOIN {name}_sparse s ON s.{key} = k.{key} AND s.bucket = b.bucket GROUP BY k.{key})"""


def chunk_store(processed: str) -> str:
    """CTEs of the whole ingest job, ending in store_."""
    return f"""{CHUNKS}, {EXTRACTIVE},
bare_store AS (SELECT c.chunk_id, c.source, {file_name('c.source')} AS file_name, c.page, c.chunk_index,
  {prefixed('c.chunk_index', "coalesce(s.document_summary, '')", 'c.page_content')} AS page_content,
  {text(processed)} AS processed_date, coalesce(s.document_summary, '') AS document_summary
  FROM chunks_ c LEFT JOIN summaries s ON s.source = c.source),
{embedded('bare_store', 'chunk_id', 'page_content', 'store_vectors')},
store_ AS (SELECT b.*, v.embedding FROM bare_store b JOIN store_vectors v ON v.chunk_id = b.chunk_id)"""


ASKED = "asked AS (SELECT vec_id AS query_id, embedding AS query_vec, CAST({k} AS INTEGER) AS k, label AS query_label FROM embeddings)"
EACH_K = "5 + 3 * label"


def asked(k: int | str = EACH_K) -> str:
    return ASKED.format(k=k)


def nearest(fetch: str = "greatest(3 * k, 50)", condition: str = "true", store: str = "store_") -> str:
    """CTEs that end in candidates(query_id, k, rank, chunk_id, distance, vec, similarity)."""
    return f"""pairs AS (SELECT q.query_id, q.k, s.chunk_id,
  round(list_distance(CAST(q.query_vec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 6) AS distance,
  row_number() OVER (PARTITION BY q.query_id ORDER BY
    round(list_distance(CAST(q.query_vec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])), 6), s.chunk_id) AS rank
  FROM asked q JOIN {store} s ON {condition}),
candidates AS (SELECT p.query_id, p.k, CAST(p.rank AS INTEGER) AS rank, p.chunk_id, p.distance, CAST(s.embedding AS DOUBLE[]) AS vec,
  list_cosine_similarity(CAST(q.query_vec AS DOUBLE[]), CAST(s.embedding AS DOUBLE[])) AS similarity
  FROM pairs p JOIN {store} s ON s.chunk_id = p.chunk_id JOIN asked q ON q.query_id = p.query_id WHERE p.rank <= {fetch.replace('k', 'p.k')})"""


def mmr(balance: str = str(K.MMR_LAMBDA), more: str = "") -> str:
    """CTEs that end in found(query_id, pos, rank, chunk_id, similarity, vec): one choice per recursion step."""
    key = f"query_id{more}"
    return f"""mmr_ AS (
  SELECT {key}, k, rank, chunk_id, similarity, vec, 1 AS step, CAST(-1e300 AS DOUBLE) AS worst,
    row_number() OVER (PARTITION BY {key} ORDER BY round(similarity, 9) DESC, rank) = 1 AS picked FROM candidates
  UNION ALL
  SELECT {key}, k, rank, chunk_id, similarity, vec, step, worst,
    row_number() OVER (PARTITION BY {key} ORDER BY round({balance} * similarity - (1 - {balance}) * worst, 9) DESC, rank) = 1 AS picked
  FROM (SELECT {', '.join('m.' + c.strip() for c in key.split(','))}, m.k, m.rank, m.chunk_id, m.similarity, m.vec, m.step + 1 AS step,
      greatest(m.worst, list_cosine_similarity(m.vec, p.vec)) AS worst
    FROM mmr_ m JOIN mmr_ p ON {' AND '.join(f'm.{c.strip()} = p.{c.strip()}' for c in key.split(','))} AND p.picked
    WHERE NOT m.picked AND m.step < m.k) x),
found AS (SELECT {key}, step AS pos, rank, chunk_id, similarity, vec FROM mmr_ WHERE picked)"""


RESULTS = "results AS (SELECT f.query_id, f.pos, s.* FROM found f JOIN store_ s ON s.chunk_id = f.chunk_id)"


def searched(k: int | str = EACH_K) -> str:
    return f"{chunk_store(PROCESSED)}, {asked(k)}, {nearest()}, {mmr()}, {RESULTS}"


def contexts(order: str, origin: str, name: str = "contexts_") -> str:
    """CTEs that end in contexts_(query_id, context, source_list, fragments)."""
    return f"""cited AS (SELECT query_id, {order} AS ord, {citation('file_name', 'page')} AS citation,
  'FRAGMENTO [' || {order} || '] (Pág ' || coalesce(CAST(page AS VARCHAR), '?') || '):' || chr(10) || {one_line('page_content')} AS fragment
  FROM {origin}),
first_seen AS (SELECT query_id, citation, min(ord) AS ord FROM cited GROUP BY ALL),
lists AS (SELECT query_id, chr(10) || {text(K.SOURCES_MARKER)} || chr(10) || string_agg('- ' || citation, chr(10) ORDER BY ord) AS source_list
  FROM first_seen GROUP BY query_id),
texts AS (SELECT query_id, string_agg(fragment, chr(10) || chr(10) ORDER BY ord) AS context, count(*) AS fragments FROM cited GROUP BY query_id),
{name} AS (SELECT t.query_id, context, source_list, fragments FROM texts t JOIN lists l ON l.query_id = t.query_id)"""


ORDERED = """ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY coalesce(page, 999), pos) AS INTEGER) AS ord FROM results)"""
