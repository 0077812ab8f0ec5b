"""JSON recovered from noisy generated texts, scores, reports, strategies."""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import jsons, payload, text
from prepbank.plans import flows, views
from prepbank.plans.registered.base import HISTORY, REQUESTS, RESPONSES, query, quoted, sql_avg, sql_strip, with_views
from prepbank.plans.registered.scores import ORDER, logged, new_table
from prepbank.plans.registered.texts import POINTS


def _sql_fenceless(x):
    return sql_strip(f"regexp_replace({x}, '```json|```', '', 'g')")


_FOUND = rf"""found AS (
  SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body END AS whole FROM (
    SELECT *, coalesce(nullif(regexp_extract(raw, '(?s)\{{.*\}}'), ''), {_sql_fenceless("raw")}) AS body FROM responses))"""

_SCORED = """scored AS (
  SELECT *, CASE WHEN json_type(whole) = 'OBJECT' THEN
      CASE WHEN json_type(whole, '$.score') IS NULL THEN 5.0
           ELSE TRY_CAST(json_extract_string(whole, '$.score') AS DOUBLE) END END AS score FROM found)"""


@query(
    "h23_recover_json",
    with_views(RESPONSES, _FOUND)
    + "SELECT id, body, whole IS NOT NULL AS parsed, json_extract_string(whole, '$.summary') AS summary FROM found",
)
def recover_json(spark, folder):
    v = payload.recover_json(F.col("raw"))
    return views.responses(spark, folder).select(
        "id", payload.json_text(F.col("raw")).alias("body"), v.isNotNull().alias("parsed"),
        jsons.text_field(v, "summary").alias("summary"),
    )


@query(
    "h24_recover_json_fenced",
    with_views(RESPONSES)
    + f"""SELECT id, json_valid(body) AND body <> '' AS parsed,
  CASE WHEN json_valid(body) AND body <> '' THEN json_extract_string(body, '$.k') END AS k
FROM (SELECT id, {_sql_fenceless("raw")} AS body FROM responses)""",
)
def recover_json_fenced(spark, folder):
    v = payload.recover_json_fenced(F.col("raw"))
    return views.responses(spark, folder).select(
        "id", v.isNotNull().alias("parsed"), jsons.text_field(v, "k").alias("k")
    )


@query("h25_eval_score", with_views(RESPONSES, _FOUND, _SCORED) + "SELECT id, score FROM scored")
def eval_score(spark, folder):
    score = jsons.let(payload.recover_json(F.col("raw")), payload.eval_score)
    return views.responses(spark, folder).select("id", score.alias("score"))


@query(
    "h26_eval_outcome",
    with_views(RESPONSES, _FOUND, _SCORED)
    + """SELECT id, CASE WHEN raw = '' THEN 'no_response' WHEN score IS NULL THEN 'parse_error' ELSE 'parsed' END AS outcome,
  'mock' AS without_key, 7.0::DOUBLE AS mock_score FROM scored""",
)
def eval_outcome(spark, folder):
    raw = F.col("raw")
    return views.responses(spark, folder).select(
        "id",
        payload.eval_outcome(raw).alias("outcome"),
        payload.eval_outcome(raw, F.lit(False)).alias("without_key"),
        payload.logged_score(raw, F.lit(False)).alias("mock_score"),
    )


_FIELDS = ("strengths", "weaknesses", "improvement_tips")
_FULL = """full_responses AS (SELECT event_id AS id, CASE event_id % 3
  WHEN 0 THEN 'So {"score": ' || value || ', "summary": "' || event_type || '", "strengths": ["a ' || event_type || '", "b"], '
    || '"weaknesses": ["' || user_id || '"], "improvement_tips": ["do ' || event_type || '", "rest"], "improved_answer": "Say '
    || event_type || '."} end'
  WHEN 1 THEN '{"weaknesses": [], "improved_answer": "' || event_type || '"}' ELSE props END AS raw FROM events)"""


def _full_responses(spark, folder):
    """Events as evaluations with all fields, with two of them, or other objects."""
    key, kind = F.col("event_id"), F.col("event_type")
    full = F.concat(
        F.lit('So {"score": '), F.col("value").cast("string"), F.lit(', "summary": "'), kind, F.lit('", "strengths": ["a '), kind,
        F.lit('", "b"], "weaknesses": ["'), F.col("user_id").cast("string"), F.lit('"], "improvement_tips": ["do '), kind,
        F.lit('", "rest"], "improved_answer": "Say '), kind, F.lit('."} end'),
    )
    few = F.concat(F.lit('{"weaknesses": [], "improved_answer": "'), kind, F.lit('"}'))
    raw = F.when(key % 3 == 0, full).when(key % 3 == 1, few).otherwise(F.col("props"))
    return views.table(spark, folder, "events").select(key.alias("id"), raw.alias("raw"))


def _typed(responses):
    out = responses.select("id", jsons.let(payload.recover_json(F.col("raw")), payload.evaluation).alias("e"))
    lists = [F.array_join(f"e.{name}", "|").alias(name) for name in _FIELDS]
    return out.select("id", "e.score", "e.summary", *lists, "e.improved_answer")


_TYPED = "SELECT id, score, coalesce(json_extract_string(whole, '$.summary'), '') AS summary, " + ", ".join(
    f"coalesce(array_to_string(json_extract_string(whole, '$.{name}[*]'), '|'), '') AS {name}" for name in _FIELDS
) + ", coalesce(json_extract_string(whole, '$.improved_answer'), '') AS improved_answer FROM scored"


@query("h27_evaluation", with_views(RESPONSES, _FOUND, _SCORED) + _TYPED)
def evaluation(spark, folder):
    return _typed(views.responses(spark, folder))


@query("h27_evaluation_full", with_views(_FULL, _FOUND.replace("FROM responses", "FROM full_responses"), _SCORED) + _TYPED)
def evaluation_full(spark, folder):
    return _typed(_full_responses(spark, folder))


@query(
    "h28_md_bullets",
    """SELECT conv_id, turn, array_to_string(['* ' || x FOR x IN string_split(text, chr(10))], chr(10)) AS stars,
  array_to_string(['- ' || x FOR x IN string_split(text, '. ')], chr(10)) AS dashes FROM conversations""",
)
def md_bullets(spark, folder):
    return views.table(spark, folder, "conversations").select(
        "conv_id", "turn",
        text.md_bullets(F.split("text", "\n"), "*").alias("stars"),
        text.md_bullets(F.split("text", r"\. "), "-").alias("dashes"),
    )


# ---- reports and strategies: customers as responses ----------------------------------------------------


def _report_responses(spark, folder):
    key = F.col("c_custkey")
    areas = F.concat(F.lit('{"weak_areas": ["'), "c_mktsegment", F.lit('", "'), "c_name", F.lit('"]'))
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit("Report:\n"), areas, F.lit(', "study_plan": ["read"]} bye')))
        .when(key % 5 == 1, F.concat(areas, F.lit("}")))
        .when(key % 5 == 2, F.concat(F.lit("Study "), "c_mktsegment", F.lit(" {more}")))
        .when(key % 5 == 3, F.concat(areas, F.lit(', "study_plan": 3}')))
    )
    return views.table(spark, folder, "customer").select(key.alias("session_id"), raw.alias("raw"))


_AREAS = """'{"weak_areas": ["' || c_mktsegment || '", "' || c_name || '"]'"""
_REPORTS = f"""report_responses AS (
  SELECT c_custkey AS session_id, c_custkey % 5 AS form, 'Top Weak Areas:' || chr(10) || '* ' || c_mktsegment || chr(10)
      || '* ' || c_name || chr(10) || chr(10) || 'Quick Study Plan:' AS shown,
    CASE c_custkey % 5 WHEN 0 THEN 'Report:' || chr(10) || {_AREAS} || ', "study_plan": ["read"]}} bye'
      WHEN 1 THEN {_AREAS} || '}}' WHEN 2 THEN 'Study ' || c_mktsegment || ' {{more}}'
      WHEN 3 THEN {_AREAS} || ', "study_plan": 3}}' END AS raw FROM customer)"""
_REPORT_TEXT = f"""CASE form WHEN 0 THEN shown || chr(10) || '- read' WHEN 1 THEN shown
  WHEN 4 THEN {quoted(fixed.REPORT_NO_RESPONSE)} ELSE raw END"""


@query("h29_report_text", with_views(_REPORTS) + f"SELECT session_id, {_REPORT_TEXT} AS report FROM report_responses")
def report_text(spark, folder):
    return _report_responses(spark, folder).select("session_id", payload.report_text(F.col("raw")).alias("report"))


@query(
    "flow_reports",
    with_views(HISTORY, REQUESTS, _REPORTS)
    + f"""SELECT session_id, avg_score AS average_score,
  CASE WHEN avg_score IS NULL THEN {quoted(fixed.REPORT_NO_HISTORY)} ELSE {_REPORT_TEXT} END AS report
FROM requests JOIN report_responses USING (session_id)
LEFT JOIN (SELECT session_id, {sql_avg("score")} AS avg_score FROM history GROUP BY 1) USING (session_id)""",
)
def reports(spark, folder):
    return flows.reports(views.requests(spark, folder), views.history(spark, folder), _report_responses(spark, folder))


def _strategy_responses(spark, folder):
    key = F.col("c_custkey")
    raw = (
        F.when(key % 5 == 0, F.concat(F.lit('ok {"strategy_bullets": ["Read '), "c_name", F.lit('", 4, "Rest"]}\n')))
        .when(key % 5 == 1, F.concat(F.lit('{"strategy_bullets": "'), "c_name", F.lit('"')))
        .when(key % 5 == 2, F.lit("```json\n{}\n```"))
        .when(key % 5 == 3, "")
    )
    return views.table(spark, folder, "customer").select(key.alias("session_id"), raw.alias("raw"))


@query(
    "h30_strategy_text",
    with_views(REQUESTS)
    + f"""SELECT session_id, CASE WHEN length({sql_strip("CASE WHEN session_id % 7 = 0 THEN ' short ' ELSE resume END")}) < 15
    THEN {quoted(fixed.SHORT_BACKGROUND)}
  ELSE CASE session_id % 5 WHEN 0 THEN '* Read ' || profile_name || chr(10) || '* 4' || chr(10) || '* Rest'
    WHEN 1 THEN {quoted(fixed.STRATEGY_BAD_PARSE)} WHEN 2 THEN '' ELSE {quoted(fixed.STRATEGY_NO_RESPONSE)} END END AS strategy,
  {quoted(fixed.STRATEGY_NO_KEY)} AS without_key FROM requests""",
)
def strategy_text(spark, folder):
    resume = F.when(F.col("session_id") % 7 == 0, " short ").otherwise(F.col("resume"))
    asked = views.requests(spark, folder).withColumn("resume", resume)
    without = payload.strategy_text(F.lit(""), F.lit(None).cast("string"), F.lit(False))
    keyed = flows.strategies(asked, _strategy_responses(spark, folder))
    return keyed.withColumn("without_key", without)


@query(
    "flow_framed_answers",
    f"""SELECT conv_id AS session_id, turn, CASE WHEN raw <> '' THEN {sql_strip("regexp_replace(ltrim_raw, '(?s)\\n```.*', '')")}
  ELSE points END AS framed_answer
FROM (SELECT conv_id, turn, raw, {sql_strip("CASE WHEN starts_with(lower(raw), 'answer:') THEN substr(raw, 8) ELSE raw END")} AS ltrim_raw, points
  FROM (SELECT conv_id, turn, {POINTS} AS points FROM conversations)
  LEFT JOIN (SELECT doc_id AS conv_id, CASE doc_id % 3 WHEN 0 THEN 'ANSWER:  ' || text || chr(10) || '``` x'
    WHEN 1 THEN text ELSE '' END AS raw FROM documents) USING (conv_id))""",
)
def framed_answers(spark, folder):
    """Every turn of a conversation as an answer, its sentences as the key points."""
    answers = views.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", F.split("text", r"\.").alias("key_points")
    )
    key = F.col("doc_id")
    raw = F.when(key % 3 == 0, F.concat(F.lit("ANSWER:  "), "text", F.lit("\n``` x"))).when(key % 3 == 1, F.col("text"))
    responses = views.table(spark, folder, "documents").select(
        key.alias("session_id"), F.coalesce(raw, F.lit("")).alias("raw")
    )
    return flows.framed_answers(answers, responses)


@query(
    "flow_evaluated_scores",
    with_views(RESPONSES, _FOUND, _SCORED)
    + "SELECT session_id, question, timestamp, score FROM scored WHERE raw <> '' AND score IS NOT NULL",
)
def evaluated_scores(spark, folder):
    return flows.evaluated_scores(views.responses(spark, folder))


# ---- evaluate, log, show ----------------------------------------------------------------------------------

_KEYED = """evaluated AS (
  SELECT id, session_id, question, timestamp, body, id % 7 <> 0 AS keyed,
    CASE WHEN id % 7 = 0 THEN 'mock' WHEN raw = '' THEN 'no_response' WHEN score IS NULL THEN 'parse_error'
      ELSE 'parsed' END AS outcome,
    CASE WHEN id % 7 = 0 THEN 7.0 WHEN raw <> '' THEN score END AS logged FROM scored)"""
_LOGGED = """logged AS (
  SELECT row_number() OVER (ORDER BY timestamp, session_id, question, logged) AS id, session_id, question, logged AS score,
    timestamp FROM (SELECT CAST(session_id AS VARCHAR) AS session_id, question, logged, timestamp FROM evaluated
    WHERE logged IS NOT NULL))"""


def _evaluate(spark, folder):
    """Every seventh response comes without credentials. The evaluated responses, and the table their scores are in."""
    table = new_table(spark, "evaluate")
    has_key = F.col("id") % 7 != 0
    return flows.evaluate_and_log(views.responses(spark, folder), table, has_key, ORDER), table


@query(
    "h26_feedback",
    with_views(RESPONSES, _FOUND, _SCORED, _KEYED)
    + f"""SELECT id, outcome, logged AS score,
  CASE outcome WHEN 'mock' THEN {quoted(fixed.MOCK_EVALUATION)} WHEN 'parsed' THEN body END AS feedback FROM evaluated""",
)
def evaluated_feedback(spark, folder):
    return _evaluate(spark, folder)[0].select("id", "outcome", "score", "feedback")


@query(
    "flow_evaluate_and_log",
    with_views(RESPONSES, _FOUND, _SCORED, _KEYED, _LOGGED) + "SELECT id, session_id, question, score, timestamp FROM logged",
)
def evaluate_and_log(spark, folder):
    """The score table after the evaluated responses were logged."""
    return logged(spark, _evaluate(spark, folder)[1])


@query(
    "flow_session_page",
    with_views(RESPONSES, _FOUND, _SCORED, _KEYED, _LOGGED)
    + f"""SELECT session_id, session_no, avg_display, strftime(newest, '%-m/%-d/%Y, %-I:%M:%S %p') AS date,
  row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS question_no, question, score,
  CAST(NULL AS VARCHAR) AS message
FROM logged JOIN (SELECT session_id, max(timestamp) AS newest, printf('%.1f', {sql_avg("score")}) AS avg_display,
    row_number() OVER (ORDER BY max(timestamp) DESC, session_id) AS session_no FROM logged GROUP BY session_id) USING (session_id)""",
)
def session_page(spark, folder):
    """Responses evaluated, logged, read back and laid out as the history page."""
    return flows.session_page(spark.table(_evaluate(spark, folder)[1]))
