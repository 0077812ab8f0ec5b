"""Text expressions, each over whole texts of the given tables.

The tables hold no numbered questions, fences or labelled sections, so the queries wrap the stored texts in them.
"""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import prompts, text
from prepbank.operators import bank as banks
from prepbank.operators.ordering import lookup
from prepbank.plans import views
from prepbank.plans.registered.base import (
    BANK,
    REQUESTS,
    query,
    quoted,
    sql_fill,
    sql_page_trim,
    sql_strip,
    with_views,
)
from prepbank.sources import bank_files

_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _documents(spark, folder):
    return views.table(spark, folder, "documents")


def _wrapped(spark, folder, out, *pieces):
    """doc_id and a concat of literal strings and document columns."""
    columns = [p if not isinstance(p, str) else F.lit(p) for p in pieces]
    return _documents(spark, folder).select("doc_id", F.concat(*columns).alias(out))


def sql_clean_question(x):
    x = rf"regexp_replace({x}, '_([^\n]*?)_', '\1', 'g')"
    x = rf"regexp_replace({x}, '\*([^\n]*?)\*', '\1', 'g')"
    return sql_strip(rf"regexp_replace({x}, '\A\p{{Nd}}+\.{_SPACE}*', '')")


def sql_role(x):
    cases = " ".join(
        f"WHEN regexp_matches(lower({x}), '{'|'.join(words)}') THEN {quoted(role)}"
        for role, words in fixed.ROLE_KEYWORDS.items()
    )
    return f"CASE {cases} ELSE {quoted(fixed.FALLBACK_ROLE)} END"


# ---- questions ------------------------------------------------------------------------------------


@query(
    "h2_clean_question",
    f"""SELECT doc_id, {sql_clean_question("s")} AS cleaned FROM (
  SELECT doc_id, doc_id || '. _' || source || '_ asks *' || lang || '* about' || chr(9) || text || '  ' || chr(10) AS s
  FROM documents)""",
)
def clean_question(spark, folder):
    c = F.col
    df = _wrapped(
        spark, folder, "s", c("doc_id").cast("string"), ". _", c("source"), "_ asks *", c("lang"), "* about\t",
        c("text"), "  \n",
    )
    return df.select("doc_id", text.clean_question(c("s")).alias("cleaned"))


@query(
    "h3_strip",
    f"""SELECT doc_id, {sql_strip("chr(160) || ' ' || chr(10) || text || chr(8195) || chr(31) || chr(9)")} AS stripped
FROM documents""",
)
def strip(spark, folder):
    df = _wrapped(spark, folder, "s", "\xa0 \n", F.col("text"), " \x1f\t")
    return df.select("doc_id", text.strip(F.col("s")).alias("stripped"))


@query("h4_classify_role", f"SELECT doc_id, {sql_role('text')} AS role, {sql_role('source || lang')} AS short FROM documents")
def classify_role(spark, folder):
    return _documents(spark, folder).select(
        "doc_id",
        text.classify_role(F.col("text")).alias("role"),
        text.classify_role(F.concat("source", "lang")).alias("short"),
    )


@query(
    "b4_is_question",
    """SELECT doc_id, strpos(text || '?', '?') > 0 AND length(text || '?') > 15 AS asks,
  strpos(source || '? ' || lang || doc_id || ' ok', '?') > 0 AND length(source || '? ' || lang || doc_id || ' ok') > 15
    AS short_asks,
  strpos(text, '?') > 0 AND length(text) > 15 AS plain FROM documents""",
)
def is_question(spark, folder):
    short = F.concat(F.col("source"), F.lit("? "), F.col("lang"), F.col("doc_id").cast("string"), F.lit(" ok"))
    return _documents(spark, folder).select(
        "doc_id",
        text.is_question(F.concat("text", F.lit("?"))).alias("asks"),
        text.is_question(short).alias("short_asks"),
        text.is_question(F.col("text")).alias("plain"),
    )


@query(
    "b5_resume_gate",
    with_views(REQUESTS)
    + f"""SELECT session_id,
  CASE WHEN length({sql_strip("resume")}) < 15 THEN {quoted(fixed.SHORT_BACKGROUND)} END AS long_message,
  CASE WHEN length({sql_strip("'  ' || profile_name[14:] || chr(10)")}) < 15
       THEN {quoted(fixed.SHORT_BACKGROUND)} END AS short_message
FROM requests""",
)
def resume_gate(spark, folder):
    short = F.concat(F.lit("  "), F.substr("profile_name", F.lit(14)), F.lit("\n"))
    return views.requests(spark, folder).select(
        "session_id",
        text.resume_gate(F.col("resume")).alias("long_message"),
        text.resume_gate(short).alias("short_message"),
    )


@query(
    "b6_is_project_question",
    """SELECT event_id, regexp_matches(s, '(?i)project|built|developed|implemented|deployed|worked on') AS project
FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'What have you BUILT' WHEN 'view' THEN 'Name a projection'
  WHEN 'error' THEN 'Who Worked  on it' ELSE 'We worked on ' || event_type END || props AS s FROM events)""",
)
def is_project_question(spark, folder):
    kind = F.col("event_type")
    said = (
        F.when(kind == "click", "What have you BUILT").when(kind == "view", "Name a projection")
        .when(kind == "error", "Who Worked  on it").otherwise(F.concat(F.lit("We worked on "), kind))
    )
    return views.table(spark, folder, "events").select(
        "event_id", text.is_project_question(F.concat(said, "props")).alias("project")
    )


@query(
    "b7_require_nonblank",
    f"""SELECT conv_id, turn, text FROM conversations
WHERE length({sql_page_trim("text")}) > 0 AND length({sql_page_trim("CASE WHEN turn % 2 = 0 THEN role ELSE ' ' || chr(10) END")}) > 0""",
)
def require_nonblank(spark, folder):
    name = F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" \n")
    df = views.table(spark, folder, "conversations").withColumn("name", name)
    return banks.require_nonblank(df, "text", "name").select("conv_id", "turn", "text")


@query(
    "b8_index_rows",
    with_views(BANK)
    + f"""SELECT id, {sql_fill(fixed.DOCUMENT_TEXT, role="role", type="type", question="question")} AS document,
  role, question, model_answer, type FROM bank""",
)
def index_rows(spark, folder):
    return banks.index_rows(views.bank(spark, folder))


@query(
    "b9_route_files",
    f"""SELECT page_id, path, kind, CASE WHEN kind = 'unsupported' THEN {quoted(fixed.UNSUPPORTED_FILE)} END AS message
FROM (SELECT page_id, path, CASE WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.docx' THEN 'docx'
             ELSE 'unsupported' END AS kind
      FROM (SELECT page_id, url || (['.PDF', '.docx', '.txt', ''])[page_id % 4 + 1] AS path FROM pages))""",
)
def route_files(spark, folder):
    ends = F.array(*[F.lit(e) for e in (".PDF", ".docx", ".txt", "")])
    path = F.concat("url", F.element_at(ends, (F.col("page_id") % 4 + 1).cast("int")))
    return bank_files.route_files(views.table(spark, folder, "pages").select("page_id", path.alias("path")))


@query(
    "b10_answer_or_default",
    f"""SELECT doc_id, coalesce(nullif(CASE quality WHEN 0 THEN '' WHEN 1 THEN text END, ''),
  {quoted(fixed.NO_ANSWER)}) AS answer FROM documents LEFT JOIN labels USING (doc_id)""",
)
def answer_or_default(spark, folder):
    rows = _documents(spark, folder).join(views.table(spark, folder, "labels"), "doc_id", "left")
    given = F.when(F.col("quality") == 0, "").when(F.col("quality") == 1, F.col("text"))
    return rows.select("doc_id", text.answer_or_default(given).alias("answer"))


@query(
    "h5_doc_text",
    with_views(BANK)
    + f"SELECT id, {sql_fill(fixed.DOCUMENT_TEXT, role='role', type='type', question='question')} AS document FROM bank",
)
def doc_text(spark, folder):
    document = text.doc_text(F.col("role"), F.col("type"), F.col("question"))
    return views.bank(spark, folder).select("id", document.alias("document"))


@query(
    "h6_query_text",
    with_views(REQUESTS)
    + f"""SELECT session_id, {sql_fill(fixed.QUERY_TEXT, role="role", resume="resume",
  question_type="coalesce(question_type, 'Technical')")} AS query FROM requests""",
)
def query_text(spark, folder):
    kind = F.coalesce("question_type", F.lit(fixed.DEFAULT_TYPE))
    out = text.query_text(F.col("role"), F.col("resume"), kind)
    return views.requests(spark, folder).select("session_id", out.alias("query"))


@query(
    "h7_difficulty_label",
    """SELECT doc_id, CASE WHEN strpos(lower(s), 'explain') > 0 THEN 'medium' ELSE 'hard' END AS difficulty
FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'EXplain ' ELSE '' END || text AS s FROM documents)""",
)
def difficulty_label(spark, folder):
    lead = F.when(F.col("lang") == "en", "EXplain ").otherwise("")
    label = text.difficulty_label(F.concat(lead, "text"))
    return _documents(spark, folder).select("doc_id", label.alias("difficulty"))


@query(
    "h8_answer_strategy",
    f"""SELECT event_id, CASE WHEN event_type = 'view' THEN 'Flow Driven' WHEN role = 'Data Scientist' THEN 'STAR Method'
  ELSE 'Direct Answer' END AS strategy FROM (
  SELECT event_id, event_type, {sql_role("event_type || props")} AS role FROM events)""",
)
def answer_strategy(spark, folder):
    role = text.classify_role(F.concat("event_type", "props"))
    strategy = text.answer_strategy(role, F.col("event_type") == "view")
    return views.table(spark, folder, "events").select("event_id", strategy.alias("strategy"))


@query(
    "h9_tags",
    f"""SELECT doc_id, role || '|' || CASE WHEN lang = 'en' THEN 'Concepts' ELSE 'Technical' END AS tags,
  CASE WHEN lang = 'en' THEN 'Core Concept' ELSE 'Technical Topic' END AS category
FROM (SELECT doc_id, lang, {sql_role("text")} AS role FROM documents)""",
)
def tags(spark, folder):
    extracted = F.col("lang") == "en"
    return _documents(spark, folder).select(
        "doc_id",
        F.array_join(text.tags(text.classify_role(F.col("text")), extracted), "|").alias("tags"),
        text.category(extracted).alias("category"),
    )


@query(
    "h10_template_answer",
    f"SELECT doc_id, {sql_fill(fixed.EXTRACTED_ANSWER, question='text')} AS answer FROM documents",
)
def template_answer(spark, folder):
    return _documents(spark, folder).select("doc_id", text.template_answer(F.col("text")).alias("answer"))


# ---- generated text ---------------------------------------------------------------------------------


def _turns(spark, folder, lead, tail):
    """Conversation texts with a lead by turn and a tail."""
    leads = F.element_at(F.array(*[F.lit(x) for x in lead]), (F.col("turn") % len(lead) + 1).cast("int"))
    return views.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.concat(leads, "text", F.lit(tail)).alias("s")
    )


def _sql_turns(lead, tail):
    leads = ", ".join(quoted(x) for x in lead)
    return f"(SELECT conv_id, turn, ([{leads}])[turn % {len(lead)} + 1] || text || {quoted(tail)} AS s FROM conversations)"


@query(
    "h11_strip_fences",
    f"""SELECT conv_id, turn, {sql_strip("regexp_replace(s, '```json|```', '', 'g')")} AS cleaned
FROM {_sql_turns(["```json", "``` x ", ""], "``` ")}""",
)
def strip_fences(spark, folder):
    df = _turns(spark, folder, ["```json", "``` x ", ""], "``` ")
    return df.select("conv_id", "turn", text.strip_fences(F.col("s")).alias("cleaned"))


def _sql_drop_answer(x):
    return f"CASE WHEN starts_with(lower({x}), 'answer:') THEN {sql_strip(f'substr({x}, 8)')} ELSE {x} END"


@query(
    "h12_strip_prefix",
    f"""SELECT conv_id, turn, {_sql_drop_answer("s")} AS cleaned FROM (
  SELECT conv_id, turn, {_sql_drop_answer("s")} AS s FROM
  {_sql_turns(["Answer: ANSWER:", "answer:", "Answer:answer:Answer: ", " answer:", ""], " ")})""",
)
def strip_prefix(spark, folder):
    df = _turns(spark, folder, ["Answer: ANSWER:", "answer:", "Answer:answer:Answer: ", " answer:", ""], " ")
    return df.select("conv_id", "turn", text.strip_prefix(F.col("s")).alias("cleaned"))


@query(
    "h13_strip_trailing_fence",
    rf"""SELECT conv_id, turn, regexp_replace(s, '(?s)\n```.*\z', '') AS cleaned
FROM (SELECT conv_id, turn, s || CASE WHEN turn % 2 = 0 THEN chr(10) || '```' || chr(10) || s || chr(10) || '```' ELSE '```' END AS s
      FROM {_sql_turns(["", "```"], "")})""",
)
def strip_trailing_fence(spark, folder):
    df = _turns(spark, folder, ["", "```"], "")
    fenced = F.concat("s", F.lit("\n```\n"), "s", F.lit("\n```"))
    whole = F.when(F.col("turn") % 2 == 0, fenced).otherwise(F.concat("s", F.lit("```")))
    return df.select("conv_id", "turn", text.strip_trailing_fence(whole).alias("cleaned"))


def _feedback(spark, folder):
    """Documents as evaluation texts: sections around the whole text, some missing, with code and notes at the end."""
    c = F.col
    n = c("doc_id") % 4
    mark = (c("n_chars") % 11).cast("string")
    score = F.when(n == 3, F.lit("")).otherwise(F.concat(F.lit("Score: "), mark, F.lit("/10 /10\n")))
    summary = F.when(n == 3, F.concat(F.lit("Plain "), "text")).otherwise(F.concat(F.lit("SUMMARY:\n"), "text"))
    strengths = F.when(n >= 2, F.lit("")).otherwise(
        F.concat(F.lit("\nStrengths: - <b> & "), "source", F.lit("\n* *"), "lang", F.lit("\n\n# x\nrun()\nprint(1)\n  - y"))
    )
    weaknesses = F.concat(F.lit("\nWEAKNESSES:\n- "), "text")
    tips = F.when(n == 0, F.lit("\nIMPROVEMENT_TIPS:\n- read\ndef f(x):\n- no"))
    tips = tips.when(n == 1, "\nIMPROVEMENT_TIPS:\n- read\nNOTE: none").otherwise("\nIMPROVEMENT_TIPS:\n**note** x")
    improved = F.concat(F.lit("\nIMPROVED_ANSWER: "), "text", F.lit("```a\nb``` c ``` END \n"))
    body = F.when(n == 3, summary).otherwise(F.concat(score, summary, strengths, weaknesses, tips, improved))
    return _documents(spark, folder).select("doc_id", body.alias("s"))


_FEEDBACK = """feedback AS (
  SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'Plain ' || text ELSE
    'Score: ' || (n_chars % 11) || '/10 /10' || chr(10) || 'SUMMARY:' || chr(10) || text
    || CASE WHEN doc_id % 4 >= 2 THEN '' ELSE chr(10) || 'Strengths: - <b> & ' || source || chr(10) || '* *' || lang
         || chr(10) || chr(10) || '# x' || chr(10) || 'run()' || chr(10) || 'print(1)' || chr(10) || '  - y' END
    || chr(10) || 'WEAKNESSES:' || chr(10) || '- ' || text
    || chr(10) || 'IMPROVEMENT_TIPS:' || chr(10)
    || CASE doc_id % 4 WHEN 0 THEN '- read' || chr(10) || 'def f(x):' || chr(10) || '- no'
         WHEN 1 THEN '- read' || chr(10) || 'NOTE: none' ELSE '**note** x' END
    || chr(10) || 'IMPROVED_ANSWER: ' || text || '```a' || chr(10) || 'b``` c ``` END ' || chr(10) END AS s
  FROM documents)"""


def _sql_strip_tail(x):
    for start in (r"\n```", r"\ndef [a-z]", r"\nclass [A-Z]", r"(?i)\nNote:", r"(?i)\n\*\*Note"):
        x = rf"regexp_replace({x}, '(?s){start}.*', '')"
    return x


def _sql_section(label, x):
    body = rf"regexp_extract({x}, '(?is){label}:?\s*(.*?)(\n[A-Z_]+:|\z)', 1)"
    return f"nullif({_sql_strip_tail(sql_page_trim(body))}, '')"


_SECTIONS = "sections AS (SELECT doc_id, s, " + ", ".join(
    f"{_sql_section(label, 's')} AS {label.lower()}" for label in fixed.SECTION_LABELS
) + " FROM feedback)"


@query(
    "h15_section",
    with_views(_FEEDBACK, _SECTIONS)
    + "SELECT doc_id, score, summary, strengths, weaknesses, improvement_tips, improved_answer FROM sections",
)
def section(spark, folder):
    found = _feedback(spark, folder).select("doc_id", text.sections(F.col("s")).alias("x"))
    return found.select("doc_id", *[F.col(f"x.{label}").alias(label.lower()) for label in fixed.SECTION_LABELS])


@query(
    "h16_strip_tail",
    with_views(_FEEDBACK) + f"SELECT doc_id, {_sql_strip_tail('s')} AS cut FROM feedback",
)
def strip_tail(spark, folder):
    return _feedback(spark, folder).select("doc_id", text.strip_tail(F.col("s")).alias("cut"))


_LINE = sql_page_trim(r"regexp_replace(l, '\A[-*]\s*', '')")
_BULLETS = (
    "[x FOR x IN [" + _LINE + " FOR l IN string_split({x}, chr(10))] "
    r"IF length(x) > 0 AND NOT regexp_matches(x, '\A(`|#|def |print\(|no_code|\w+\(\)\z)')]"
)


@query(
    "h17_bullets",
    with_views(_FEEDBACK, _SECTIONS)
    + f"""SELECT doc_id, array_to_string({_BULLETS.format(x="strengths")}, '|') AS strengths,
  array_to_string({_BULLETS.format(x="weaknesses")}, '|') AS weaknesses FROM sections""",
)
def bullets(spark, folder):
    return _feedback(spark, folder).select(
        "doc_id",
        F.array_join(text.bullets(text.section("STRENGTHS", F.col("s"))), "|").alias("strengths"),
        F.array_join(text.bullets(text.section("WEAKNESSES", F.col("s"))), "|").alias("weaknesses"),
    )


def _sql_escape(x):
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("h18_escape_html", f"SELECT page_id, {_sql_escape('html')} AS escaped FROM pages")
def escape_html(spark, folder):
    return views.table(spark, folder, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query(
    "h19_score_text",
    with_views(_FEEDBACK, _SECTIONS)
    + "SELECT doc_id, " + sql_page_trim("regexp_replace(score, '/10', '')") + " AS score FROM sections",
)
def score_text(spark, folder):
    score = text.score_text(text.section("SCORE", F.col("s")))
    return _feedback(spark, folder).select("doc_id", score.alias("score"))


_CLEANED = sql_page_trim(
    r"regexp_replace(regexp_replace(improved_answer, '(?i)\bEND\b\s*\z', ''), '(?s)```.*?```', '', 'g')"
)


@query(
    "h20_clean_improved",
    with_views(_FEEDBACK, _SECTIONS)
    + f"SELECT doc_id, {_CLEANED} AS cleaned FROM sections",
)
def clean_improved(spark, folder):
    cleaned = text.clean_improved(text.section("IMPROVED_ANSWER", F.col("s")))
    return _feedback(spark, folder).select("doc_id", cleaned.alias("cleaned"))


@query(
    "h21_plain_or_sections",
    with_views(_FEEDBACK, _SECTIONS)
    + f"""SELECT doc_id, CASE WHEN score IS NULL AND summary IS NULL AND strengths IS NULL
  THEN '<p>' || replace({_sql_escape("s")}, chr(10), '<br>') || '</p>' END AS plain FROM sections""",
)
def plain_or_sections(spark, folder):
    return _feedback(spark, folder).select("doc_id", text.plain_or_sections(F.col("s")).alias("plain"))


@query(
    "flow_feedback_sections",
    with_views(_FEEDBACK, _SECTIONS)
    + "SELECT doc_id, "
    + _sql_escape(sql_page_trim("regexp_replace(score, '/10', '')"))
    + f""" AS score, {_sql_escape("summary")} AS summary,
  {_sql_escape("array_to_string(" + _BULLETS.format(x="strengths") + ", '|')")} AS strengths,
  {_sql_escape("array_to_string(" + _BULLETS.format(x="weaknesses") + ", '|')")} AS weaknesses,
  {_sql_escape("nullif(" + _CLEANED + ", '')")} AS improved_answer,
  {_sql_escape("array_to_string(" + _BULLETS.format(x="improvement_tips") + ", '|')")} AS improvement_tips,
  score IS NULL AND summary IS NULL AND strengths IS NULL AS is_plain FROM sections""",
)
def feedback_sections(spark, folder):
    out = _feedback(spark, folder).select("doc_id", text.feedback_sections(F.col("s")).alias("f"))
    return out.select(
        "doc_id", "f.score", "f.summary", "f.improved_answer", F.array_join("f.strengths", "|").alias("strengths"),
        F.array_join("f.weaknesses", "|").alias("weaknesses"),
        F.array_join("f.improvement_tips", "|").alias("improvement_tips"), F.col("f.plain").isNotNull().alias("is_plain"),
    )


@query("h22_nl2br", "SELECT doc_id, replace(text, chr(10), '<br>') AS shown FROM documents")
def nl2br(spark, folder):
    return _documents(spark, folder).select("doc_id", text.nl2br(F.col("text")).alias("shown"))


# ---- prompts over one row ------------------------------------------------------------------------------


@query(
    "p1_strategy_prompt",
    with_views(REQUESTS)
    + f"""SELECT session_id, {sql_fill(fixed.STRATEGY_PROMPT, profile_name="profile_name", experience="experience",
  role="role", resume="resume")} AS prompt FROM requests""",
)
def strategy_prompt(spark, folder):
    columns = {c: F.col(c) for c in ("profile_name", "experience", "role", "resume")}
    return views.requests(spark, folder).select("session_id", prompts.strategy(**columns).alias("prompt"))


POINTS = (
    "array_to_string(['- ' || p FOR p IN [" + sql_page_trim("x") + " FOR x IN string_split(text, '.')] IF p <> ''], chr(10))"
)


@query(
    "h31_key_points",
    f"SELECT conv_id, turn, {POINTS} AS points FROM conversations",
)
def key_points(spark, folder):
    points = text.md_bullets(text.key_points(F.split("text", r"\.")))
    return views.table(spark, folder, "conversations").select("conv_id", "turn", points.alias("points"))


@query(
    "p3_frame_prompt",
    f"""SELECT conv_id, turn, {sql_fill(fixed.FRAME_PROMPT, experience="'Mid'", role="role", question="role",
  points=POINTS)} AS prompt FROM conversations""",
)
def frame_prompt(spark, folder):
    prompt = prompts.frame(F.col("role"), F.split("text", r"\."), F.lit("Mid"), F.col("role"))
    return views.table(spark, folder, "conversations").select("conv_id", "turn", prompt.alias("prompt"))


@query(
    "p4_evaluation_prompt",
    with_views(BANK)
    + f"""SELECT conv_id, turn, {sql_fill(fixed.EVALUATION_PROMPT, question="b.question", model_answer="b.model_answer",
  user_answer="c.text")} AS prompt FROM conversations c JOIN bank b ON c.conv_id = b.id""",
)
def evaluation_prompt(spark, folder):
    asked = views.bank(spark, folder).select(F.col("id").alias("conv_id"), "question", "model_answer")
    answers = views.table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("user_answer"))
    prompt = prompts.evaluation(F.col("question"), F.col("model_answer"), F.col("user_answer"))
    return lookup(answers, asked, ["conv_id"], "inner").select("conv_id", "turn", prompt.alias("prompt"))
