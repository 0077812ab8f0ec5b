"""Bank files, extraction from pages, role banks, behavioural rows."""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import text
from prepbank.operators import bank as b
from prepbank.plans import flows, views
from prepbank.plans.registered.base import BANK, query, quoted, sql_draw, sql_fill, sql_strip, with_views
from prepbank.plans.registered.texts import sql_clean_question, sql_role
from prepbank.session import fresh_path
from prepbank.sources import bank_files

# ---- pages that carry a JSON list: the stored page with a script element composed of its own parts -------


def _title(html):
    return F.regexp_extract(html, r"<title>([^\n]*?)</title>", 1)


def _pages(spark, folder):
    """Pages with a JSON script: a list on two pages of three, else an object or a broken list."""
    pages = bank_files.read_pages(spark, f"{folder}/pages.parquet")
    title = F.regexp_replace(_title(F.col("html")), r'["\\]', "'")
    key = F.col("page_id")
    items = F.concat(
        F.lit('["1. What does _'), title, F.lit('_ mean?", 7, null, ["inner?"], "Explain '), title,
        F.lit(' ?", "short?", "no marker in this text", "Which *model* fits '),
        (key % 7).cast("string"), F.lit(' rows?", {"q": "x?"}]'),
    )
    body = F.when(key % 6 == 4, F.concat(F.lit('{"list": '), items, F.lit("}"))).when(
        key % 6 == 5, F.concat(items, F.lit(" ]"))
    ).otherwise(items)
    script = F.concat(F.lit('<script type="application/json" id="data">'), body, F.lit("</script>"))
    return pages.withColumn("html", F.concat("html", script))


_PAGES = r"""titled AS (
  SELECT page_id, url, html, regexp_replace(regexp_extract(html, '<title>([^\n]*?)</title>', 1), '["\\]', '''', 'g') AS title
  FROM pages),
listed AS (
  SELECT *, '["1. What does _' || title || '_ mean?", 7, null, ["inner?"], "Explain ' || title
    || ' ?", "short?", "no marker in this text", "Which *model* fits ' || (page_id % 7) || ' rows?", {"q": "x?"}]' AS items
  FROM titled),
scripted AS (
  SELECT page_id, url, html || '<script type="application/json" id="data">'
    || CASE page_id % 6 WHEN 4 THEN '{"list": ' || items || '}' WHEN 5 THEN items || ' ]' ELSE items END
    || '</script>' AS html FROM listed),
bodies AS (
  SELECT page_id, regexp_extract(html, '<script type="application/json"[^>]*>([^\n]*?)</script>', 1) AS body
  FROM scripted),
items AS (
  SELECT page_id, unnest(json_extract(body, '$[*]')) AS item FROM bodies
  WHERE json_valid(body) AND json_type(body) = 'ARRAY'),
strings AS (
  SELECT page_id, json_extract_string(item, '$') AS raw FROM items WHERE json_type(item) = 'VARCHAR')"""

_QUESTIONS = f"""questions AS (
  SELECT DISTINCT {sql_clean_question("raw")} AS question FROM strings WHERE strpos(raw, '?') > 0 AND length(raw) > 15)"""


@query("a8_read_pages", "SELECT page_id, url, length(html)::INTEGER AS size FROM pages")
def read_pages(spark, folder):
    pages = bank_files.read_pages(spark, f"{folder}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").alias("size"))


@query("h1_extract_strings", with_views(_PAGES) + "SELECT page_id, raw FROM strings")
def extract_strings(spark, folder):
    return _pages(spark, folder).select("page_id", F.explode(text.extract_strings(F.col("html"))).alias("raw"))


@query("b3_string_elements", with_views(_PAGES) + "SELECT page_id, count(*) AS strings FROM strings GROUP BY page_id")
def string_elements(spark, folder):
    found = _pages(spark, folder).select("page_id", text.extract_strings(F.col("html")).alias("found"))
    sized = found.where(F.col("found").isNotNull())
    return sized.select("page_id", F.size("found").cast("bigint").alias("strings"))


@query("g1_distinct_questions", "SELECT DISTINCT text AS question FROM documents")
def distinct_questions(spark, folder):
    return b.distinct_questions(views.bank(spark, folder))


@query("k1_extract_questions", with_views(_PAGES, _QUESTIONS) + "SELECT question FROM questions")
def extract_questions(spark, folder):
    return b.extract_questions(_pages(spark, folder))


# ---- curated lists: documents stand in for curated topics, by role of their language -------------------

_LANG_ROLE = dict(zip(["en", "fr", "de", "es"], fixed.ROLES, strict=True))


def _curated(spark, folder):
    role = F.lit(None)
    for lang, name in _LANG_ROLE.items():
        role = F.when(F.col("lang") == lang, name).otherwise(role)
    return views.table(spark, folder, "documents").select(
        role.alias("role"), F.col("doc_id").alias("pos"), F.col("text").alias("question"),
        F.concat(F.lit("See "), F.col("source")).alias("model_answer"),
    )


_ROLE_CASE = " ".join(f"WHEN '{lang}' THEN '{role}'" for lang, role in _LANG_ROLE.items())
_CURATED = f"""curated AS (
  SELECT CASE lang {_ROLE_CASE} END AS role, doc_id AS pos, text AS question, 'See ' || source AS model_answer
  FROM documents)"""


def _topics(spark, folder):
    """Benchmark texts as short curated lists, most of them under the quota."""
    spread = F.array(*[F.lit(r) for r in ("Data Scientist", "Data Analyst", "Data Scientist", "Tester")])
    return views.table(spark, folder, "benchmark").select(
        F.element_at(spread, (F.col("item_id") % 4 + 1).cast("int")).alias("role"),
        F.floor(F.col("item_id") / 4).cast("bigint").alias("pos"),
        F.col("text").alias("question"),
        F.lit("a").alias("model_answer"),
    )


_TOPICS = """topics AS (
  SELECT (['Data Scientist', 'Data Analyst', 'Data Scientist', 'Tester'])[item_id % 4 + 1] AS role,
         item_id // 4 AS pos, text AS question, 'a' AS model_answer FROM benchmark)"""


def _sql_padding(n):
    parts = []
    for role, (question, answer) in fixed.PADDING.items():
        parts.append(
            f"""SELECT {quoted(role)} AS role, i AS pos, replace({quoted(question)}, '{{n}}', (i + 1)::VARCHAR) AS question,
  replace({quoted(answer)}, '{{n}}', (i + 1)::VARCHAR) AS model_answer
FROM range({n}) r(i) WHERE i >= (SELECT count(*) FROM topics WHERE role = {quoted(role)})"""
        )
    return "\nUNION ALL ".join(parts)


@query("k2_pad_to_quota", with_views(_TOPICS) + "SELECT * FROM topics UNION ALL " + _sql_padding(150))
def pad_to_quota(spark, folder):
    return b.pad_to_quota(_topics(spark, folder))


_RANKED = f"""rows AS (
  SELECT {sql_role("question")} AS role, 0 AS priority, 0 AS pos, question, NULL AS model_answer FROM questions
  UNION ALL SELECT role, 1, pos, question, model_answer FROM curated),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role, question ORDER BY priority, pos) AS first_rn FROM rows)
  WHERE first_rn = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY priority, pos, question)::INTEGER AS place FROM firsts)"""


@query(
    "e5_first_occurrences",
    with_views(_CURATED)
    + """SELECT role, pos, question FROM (
  SELECT *, row_number() OVER (PARTITION BY role, question ORDER BY pos) AS rn FROM curated) WHERE rn = 1""",
)
def first_occurrences(spark, folder):
    return b.first_occurrences(b.curated_rows(_curated(spark, folder))).select("role", "pos", "question")


@query(
    "e4_role_quota",
    with_views(_CURATED)
    + """SELECT role, pos, place FROM (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY pos, question)::INTEGER AS place FROM curated) WHERE place <= 150""",
)
def role_quota(spark, folder):
    return b.role_quota(b.curated_rows(_curated(spark, folder))).select("role", "pos", "place")


@query(
    "k3_build_bank",
    with_views(_PAGES, _QUESTIONS, _CURATED, _RANKED)
    + f"""SELECT role, CASE WHEN priority = 0 THEN 'Core Concept' ELSE 'Technical Topic' END AS category, question,
  CASE WHEN priority = 0 THEN 'Flow Driven' WHEN role = 'Data Scientist' THEN 'STAR Method' ELSE 'Direct Answer' END
    AS answer_strategy,
  role || '|' || CASE WHEN priority = 0 THEN 'Concepts' ELSE 'Technical' END AS tags,
  CASE WHEN priority = 0 OR strpos(lower(question), 'explain') > 0 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN priority = 0 THEN {sql_fill(fixed.EXTRACTED_ANSWER, question="question")} ELSE model_answer END AS model_answer,
  place FROM placed WHERE place <= 150""",
)
def build_bank(spark, folder):
    bank = b.build_bank(b.extract_questions(_pages(spark, folder)), _curated(spark, folder))
    return bank.withColumn("tags", F.array_join("tags", "|"))


@query(
    "g2_union_roles",
    "SELECT lang AS role, text AS question FROM documents UNION ALL SELECT 'test' AS role, text AS question FROM benchmark",
)
def union_roles(spark, folder):
    rows = views.bank(spark, folder).select("role", "question")
    items = views.table(spark, folder, "benchmark").select(F.lit("test").alias("role"), F.col("text").alias("question"))
    return b.union_roles(rows, items)


@query(
    "g3_extracted_first",
    with_views(_PAGES, _QUESTIONS, _CURATED, _RANKED) + "SELECT role, priority, pos, question FROM rows",
)
def extracted_first(spark, folder):
    rows = b.extracted_rows(b.extract_questions(_pages(spark, folder)))
    rows = rows.unionByName(b.curated_rows(_curated(spark, folder)))
    return rows.select("role", "priority", "pos", "question")


# ---- behavioural rows ------------------------------------------------------------------------------------


@query(
    "c5_template_grid",
    "SELECT item_id, text, role, experience FROM benchmark, "
    + f"unnest({fixed.ROLES}) r(role), unnest({fixed.LEVELS}) x(experience)",
)
def template_grid(spark, folder):
    return b.template_grid(views.table(spark, folder, "benchmark").select("item_id", "text"))


_THEME_LIST = ", ".join(quoted(t) for t, _ in fixed.THEMES)
_BASE_LIST = ", ".join(quoted(q) for _, q in fixed.THEMES)
_SOFT = f"""drawn AS (
  SELECT c_custkey AS id, {sql_draw(0, "theme", "c_custkey", len(fixed.THEMES))} AS t,
    ({fixed.ROLES})[{sql_draw(0, "role", "c_custkey", len(fixed.ROLES))}] AS role,
    ({fixed.LEVELS})[{sql_draw(0, "level", "c_custkey", len(fixed.LEVELS))}] AS experience FROM customer),
soft AS (
  SELECT id, role, 'Behavioral' AS type, experience, {sql_fill(fixed.BEHAVIORAL_QUESTION,
      theme=f"([{_THEME_LIST}])[t]", experience="experience", role="role", base_question=f"([{_BASE_LIST}])[t]")} AS question,
    {sql_fill(fixed.BEHAVIORAL_ANSWER, experience="experience", role="role")} AS model_answer,
    'STAR method' AS answer_strategy FROM drawn)"""


@query("k4_soft_skill_rows", with_views(_SOFT) + "SELECT * FROM soft")
def soft_skill_rows(spark, folder):
    return b.soft_skill_rows(views.requests(spark, folder).select(F.col("session_id").alias("id")))


@query(
    "g4_extend_bank",
    with_views(BANK, _SOFT)
    + """SELECT id, role, category, question, type, model_answer, NULL AS experience, NULL AS answer_strategy FROM bank
UNION ALL SELECT id, role, NULL, question, type, model_answer, experience, answer_strategy FROM soft""",
)
def extend_bank(spark, folder):
    soft = b.soft_skill_rows(views.requests(spark, folder).select(F.col("session_id").alias("id")))
    return b.extend_bank(views.bank(spark, folder), soft)


@query(
    "d5_bank_counts",
    "SELECT lang AS role, 0 AS is_total, count(*) AS n FROM documents GROUP BY lang "
    "UNION ALL SELECT NULL, 1, count(*) FROM documents",
)
def bank_counts(spark, folder):
    return b.bank_counts(views.bank(spark, folder))


@query(
    "flow_bank_from_pages",
    with_views(_PAGES, _QUESTIONS, _TOPICS + ", curated AS (SELECT * FROM topics UNION ALL " + _sql_padding(150) + ")", _RANKED, _SOFT)
    + f"""SELECT role, question, CASE WHEN priority = 0 THEN {sql_fill(fixed.EXTRACTED_ANSWER, question="question")}
  ELSE model_answer END AS model_answer, place, NULL AS type FROM placed WHERE place <= 150
UNION ALL SELECT role, question, model_answer, NULL, type FROM soft""",
)
def bank_from_pages(spark, folder):
    soft = b.soft_skill_rows(views.requests(spark, folder).select(F.col("session_id").alias("id"))).drop("id")
    out = flows.bank_from_pages(_pages(spark, folder), _topics(spark, folder), soft)
    return out.select("role", "question", "model_answer", "place", "type")


# ---- files ---------------------------------------------------------------------------------------------------


def _lines(spark, folder):
    """Documents as lines of a bank file in key order: JSON rows, some without keys, blank and broken lines."""
    full = F.to_json(F.struct(F.col("lang").alias("role"), F.col("text").alias("question"), F.array("lang", "source").alias("tags")))
    line = (
        F.when(F.col("doc_id") % 7 == 1, "  ")
        .when(F.col("doc_id") % 7 == 2, F.concat(F.lit("{bad "), F.col("lang")))
        .when(F.col("doc_id") % 7 == 3, F.concat(F.lit("["), F.col("n_chars").cast("string"), F.lit("]")))
        .when(F.col("doc_id") % 7 == 4, F.concat(full, F.lit(" }")))
        .when(F.col("doc_id") % 7 == 5, F.concat(F.lit('{"type": "Behavioral", "model_answer": "'), F.col("source"), F.lit('"}')))
        .otherwise(full)
    )
    rows = views.table(spark, folder, "documents").select("doc_id", line.alias("value"))
    path = fresh_path(spark, "lines")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    return path


_LINES = """numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id % 7 AS form FROM documents)"""


@query("k5_line_ids", with_views(_LINES) + "SELECT line_no, form = 1 AS blank, form = 2 AS bad FROM numbered")
def line_ids(spark, folder):
    lines = bank_files.line_ids(spark, _lines(spark, folder))
    value = F.col("value")
    return lines.select("line_no", (text.strip(value) == "").alias("blank"), value.startswith("{bad").alias("bad"))


@query(
    "a1_read_bank",
    with_views(_LINES)
    + """SELECT 'q_' || line_no AS id, line_no, CASE WHEN form = 5 THEN '' ELSE lang END AS role,
  CASE WHEN form = 5 THEN 'Behavioral' ELSE 'Technical' END AS type,
  CASE WHEN form = 5 THEN '' ELSE text END AS question, CASE WHEN form = 5 THEN source ELSE '' END AS model_answer,
  CASE WHEN form <> 5 THEN lang || '|' || source END AS tags
FROM numbered WHERE form NOT IN (1, 2, 3, 4)""",
)
def read_bank(spark, folder):
    bank = bank_files.read_bank(spark, _lines(spark, folder))
    return bank.select("id", "line_no", "role", "type", "question", "model_answer", F.array_join("tags", "|").alias("tags"))


@query("a2_write_bank", with_views(BANK) + "SELECT role, question, type, model_answer FROM bank")
def write_bank(spark, folder):
    path = fresh_path(spark, "written")
    bank_files.write_bank(views.bank(spark, folder), path)
    bank_files.write_bank(views.bank(spark, folder), path)
    return bank_files.read_bank(spark, path).select("role", "question", "type", "model_answer")


@query(
    "a3_append_bank",
    with_views(BANK, _SOFT)
    + """SELECT role, question, type, model_answer, NULL AS experience FROM bank
UNION ALL SELECT role, question, type, model_answer, experience FROM soft""",
)
def append_bank(spark, folder):
    path = fresh_path(spark, "appended")
    soft = b.soft_skill_rows(views.requests(spark, folder).select(F.col("session_id").alias("id")))
    bank_files.write_bank(views.bank(spark, folder), path)
    bank_files.append_bank(soft, path)
    return bank_files.read_bank(spark, path).select("role", "question", "type", "model_answer", "experience")


@query(
    "a4_load_index",
    with_views(BANK)
    + f"""SELECT id, {sql_fill(fixed.DOCUMENT_TEXT, role="role", type="type", question="question")} AS document, role,
  question, model_answer, type, 'TrueFalseFalse' AS loads FROM bank""",
)
def load_index(spark, folder):
    path = fresh_path(spark, "index")
    rows = b.index_rows(views.bank(spark, folder))
    soft = b.soft_skill_rows(views.requests(spark, folder).select(F.col("session_id").alias("id")))
    loads = [bank_files.load_index(rows, path), bank_files.load_index(b.index_rows(soft), path)]
    loads.append(bank_files.load_index(bank_files.bank_or_none(spark, path + "-none"), path))
    return bank_files.read_index(spark, path).withColumn("loads", F.lit("".join(str(x) for x in loads)))


@query("b1_filter_role", with_views(BANK) + "SELECT id, role, question FROM bank WHERE role = 'fr'")
def filter_role(spark, folder):
    from prepbank.operators.retrieve import filter_role as by_role

    return by_role(views.bank(spark, folder), "fr").select("id", "role", "question")


_ASSEMBLED = """SELECT conv_id AS key, turn AS part, CASE WHEN turn % 3 = 0 THEN chr(9) || role || ' ' ELSE text END AS text
  FROM conversations UNION ALL SELECT conv_id, -1, ' ' || chr(10) FROM conversations WHERE turn = 0"""


def _turn_parts(spark, folder):
    turns = views.table(spark, folder, "conversations")
    body = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\t"), "role", F.lit(" "))).otherwise(F.col("text"))
    rows = turns.select(F.col("conv_id").alias("key"), F.col("turn").alias("part"), body.alias("text"))
    lead = turns.where("turn = 0").select(
        F.col("conv_id").alias("key"), F.lit(-1).cast("bigint").alias("part"), F.lit(" \n").alias("text")
    )
    return rows.unionByName(lead)


@query(
    "d8_assemble_text",
    f"""SELECT key, 1::BIGINT AS part_no, {sql_strip("string_agg(text || chr(10), '' ORDER BY part)")} AS text
FROM ({_ASSEMBLED}) GROUP BY key""",
)
def assemble_text(spark, folder):
    return bank_files.assemble_text(_turn_parts(spark, folder), "key", "part", "text", 16 << 20)


@query(
    "d8_text_lines",
    f"""WITH given AS ({_ASSEMBLED}), spans AS (
  SELECT key, min(part) FILTER ({sql_strip("text")} <> '') AS a, max(part) FILTER ({sql_strip("text")} <> '') AS z
  FROM given GROUP BY key)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY part) AS line_no,
  CASE WHEN part = a AND part = z THEN {sql_strip("text")} WHEN part = a THEN ltrim(text, {quoted(fixed.WHITESPACE)})
       WHEN part = z THEN rtrim(text, {quoted(fixed.WHITESPACE)}) ELSE text END AS text
FROM given JOIN spans USING (key) WHERE part BETWEEN a AND z""",
)
def text_lines(spark, folder):
    return bank_files.text_lines(_turn_parts(spark, folder), "key", "part", "text")


@query(
    "a9_to_payload",
    with_views(BANK)
    + "SELECT id, to_json({'question': question, 'model_answer': model_answer, 'source': category})::VARCHAR AS payload FROM bank",
)
def to_payload(spark, folder):
    rows = views.bank(spark, folder).select("id", "question", "model_answer", F.col("category").alias("source"))
    return bank_files.to_payload(rows, "id")
