"""Registry of queries, and SQL texts of the model views for their checks."""

from string import Formatter

from prepbank import fixed

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Register a query ``(spark, folder) -> DataFrame`` and, where SQL can say it, its check."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template, **values):
    """SQL concat of a template's pieces; nulls count as ''."""
    pieces = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(quoted(literal))
        if name is not None:
            pieces.append(f"coalesce(CAST({values[name]} AS VARCHAR), '')")
    return "(" + " || ".join(pieces) + ")"


def sql_strip(x):
    return f"trim({x}, {quoted(fixed.WHITESPACE)})"


def sql_page_trim(x):
    return f"trim({x}, {quoted(fixed.PAGE_WHITESPACE)})"


def sql_draw(seed, part, key, size):
    return f"(('0x' || substr(md5('{seed}|{part}|' || {key}), 1, 8))::BIGINT % {size} + 1)"


def sql_sum(x):
    """Sum that no order of addition changes: as decimals, rounded once."""
    return f"CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(28, 18))) AS VARCHAR) AS DOUBLE)"


def sql_avg(x, over=""):
    return f"CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(28, 18))) {over} AS VARCHAR) AS DOUBLE) / count({x}) {over}"


def sql_tier(x):
    return f"CASE WHEN {x} < 5.0 THEN 'easier' WHEN {x} >= 8.0 THEN 'harder' ELSE 'none' END"


HISTORY = """history AS (
  SELECT event_id AS id, user_id AS session_id, event_type AS question,
         least(value / 10, 10.0) AS score, ts AS timestamp FROM events)"""

BANK = """bank AS (
  SELECT d.doc_id AS id, d.lang AS role, d.source AS category, d.text AS question,
         CASE WHEN l.quality = 1 THEN 'Technical' ELSE 'Behavioral' END AS type,
         'See ' || d.source || '.' AS model_answer
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

REQUESTS = """requests AS (
  SELECT c_custkey AS session_id, c_name AS profile_name,
         (['en', 'fr', 'de', 'es', 'xx'])[c_custkey % 5 + 1] AS role,
         (['Junior', 'Mid', 'Senior'])[c_custkey % 3 + 1] AS experience,
         'Works in ' || lower(c_mktsegment) || ' as account ' || c_custkey AS resume,
         CASE c_custkey % 3 WHEN 1 THEN 'Technical' WHEN 2 THEN 'Behavioral' END AS question_type
  FROM customer)"""

RECENT = f"""recent AS (
  SELECT session_id, {sql_avg("score")} AS recent_avg FROM (
    SELECT session_id, score, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS rn
    FROM history) WHERE rn <= 3 GROUP BY session_id)"""

RESPONSES = """responses AS (
  SELECT event_id AS id, user_id AS session_id, event_type AS question, ts AS timestamp,
    CASE event_id % 6
      WHEN 0 THEN 'Sure: {"score": ' || value || ', "summary": "' || event_type
                  || '", "strengths": ["a ' || event_type || '", "b"], "extra": ' || props || '} done'
      WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
      WHEN 2 THEN 'no payload for ' || event_type
      WHEN 3 THEN 'broken ' || props || ' } end'
      WHEN 4 THEN '{"score": "' || value || '/10"}'
      ELSE '' END AS raw
  FROM events)"""

RETRIEVED = """request_vectors AS (
  SELECT session_id, role, e.embedding FROM requests r JOIN embeddings e
    ON r.session_id % (SELECT count(*) FROM embeddings) = e.vec_id),
document_vectors AS (
  SELECT b.id, role, e.embedding FROM bank b JOIN embeddings e ON b.id % (SELECT count(*) FROM embeddings) = e.vec_id),
near AS (
  SELECT session_id, id, distance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY distance, id) AS rank FROM (
      SELECT q.session_id, b.id, list_sum([(p[1] - p[2]) * (p[1] - p[2])
                       FOR p IN list_zip(q.embedding::DOUBLE[], b.embedding::DOUBLE[])]) AS distance
      FROM request_vectors q JOIN document_vectors b ON q.role = b.role)) WHERE rank <= 20),
retrieved AS (SELECT session_id, id, question, model_answer, distance, rank FROM near JOIN bank USING (id)),
shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5('0|' || session_id || '|' || id), id) AS place
  FROM retrieved)"""


def with_views(*views):
    return "WITH " + ",\n".join(views) + "\n"
