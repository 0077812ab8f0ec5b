"""Score history, tiers, sessions, reports."""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import text
from prepbank.operators import history as h
from prepbank.plans import views
from prepbank.plans.registered.base import HISTORY, RECENT, REQUESTS, quoted, query, sql_avg, sql_fill, sql_sum, sql_tier, with_views
from prepbank.session import fresh_path
from prepbank.sources import score_log

# Bytes of text or of nested rows in one output row.
PART_BYTES = 16 << 20


@query(
    "c2_difficulty_tiers",
    with_views(HISTORY, REQUESTS, RECENT)
    + f"""SELECT r.session_id, r.role, coalesce(recent_avg, 5.0) AS recent_avg,
       {sql_tier("coalesce(recent_avg, 5.0)")} AS tier
FROM requests r LEFT JOIN recent USING (session_id)""",
)
def difficulty_tiers(spark, folder):
    out = h.with_tier(views.requests(spark, folder), views.history(spark, folder))
    return out.select("session_id", "role", "recent_avg", "tier")


@query(
    "d1_recent_avg",
    with_views(HISTORY, RECENT) + "SELECT session_id, recent_avg FROM recent",
)
def recent_avg(spark, folder):
    return h.recent_avg(views.history(spark, folder))


@query(
    "e1_recent_scores",
    with_views(HISTORY)
    + """SELECT session_id, id, score, rn AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC)::INTEGER AS rn FROM history)
WHERE rn <= 3""",
)
def recent_scores(spark, folder):
    return h.recent_scores(views.history(spark, folder)).select("session_id", "id", "score", "recency")


@query(
    "h14_difficulty_tier",
    with_views(HISTORY)
    + f"""SELECT id, {sql_tier("score")} AS tier,
  CASE WHEN score < 5 THEN {quoted(fixed.TIER_EASIER)} WHEN score >= 8 THEN {quoted(fixed.TIER_HARDER)}
       ELSE '' END AS tier_text FROM history""",
)
def tiers_of_scores(spark, folder):
    score = F.col("score")
    return views.history(spark, folder).select(
        "id", text.difficulty_tier(score).alias("tier"), text.tier_text(score).alias("tier_text")
    )


@query(
    "d2_session_avg",
    with_views(HISTORY) + f"SELECT session_id, {sql_avg('score')} AS avg_score FROM history GROUP BY session_id",
)
def session_avg(spark, folder):
    return h.session_avg(views.history(spark, folder))


@query(
    "d3_session_summary",
    with_views(HISTORY)
    + f"""SELECT session_id, {sql_sum("score")} AS total_score, count(score) AS questions,
       {sql_avg("score")} AS avg_score, printf('%.1f', {sql_avg("score")}) AS avg_display
FROM history GROUP BY session_id""",
)
def session_summary(spark, folder):
    return h.session_summary(views.history(spark, folder))


@query(
    "d4_history_nested",
    with_views(HISTORY)
    + """SELECT h.session_id, m.newest AS session_timestamp, 1::BIGINT AS part_no,
       row_number() OVER (PARTITION BY h.session_id ORDER BY timestamp DESC, id DESC) AS place,
       question, score, timestamp
FROM history h JOIN (SELECT session_id, max(timestamp) AS newest FROM history GROUP BY 1) m USING (session_id)""",
)
def history_nested(spark, folder):
    nested = h.history_nested(views.history(spark, folder), PART_BYTES)
    flat = nested.select(
        "session_id", F.col("timestamp").alias("session_timestamp"), "part_no", F.posexplode("questions")
    )
    return flat.select(
        "session_id", "session_timestamp", "part_no", (F.col("pos") + 1).cast("bigint").alias("place"), "col.*"
    )


@query(
    "d6_history_text",
    with_views(HISTORY)
    + f"""SELECT session_id, 1::BIGINT AS part_no,
  string_agg({sql_fill(fixed.HISTORY_LINE, question="question", score="score")}, chr(10)
             ORDER BY timestamp, id) AS history
FROM history GROUP BY session_id""",
)
def history_text(spark, folder):
    return h.history_text(views.history(spark, folder), PART_BYTES)


@query(
    "d4_history_items",
    with_views(HISTORY)
    + """SELECT h.session_id, m.newest AS timestamp, question, score, timestamp AS answered,
       row_number() OVER (PARTITION BY h.session_id ORDER BY timestamp DESC, id DESC) AS question_no
FROM history h JOIN (SELECT session_id, max(timestamp) AS newest FROM history GROUP BY 1) m USING (session_id)""",
)
def history_items(spark, folder):
    return h.history_items(views.history(spark, folder))


@query(
    "d6_history_lines",
    with_views(HISTORY)
    + f"""SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, id) AS line_no,
  {sql_fill(fixed.HISTORY_LINE, question="question", score="score")} AS line FROM history""",
)
def history_lines(spark, folder):
    return h.history_lines(views.history(spark, folder))


@query(
    "d9_report_or_empty",
    with_views(HISTORY, REQUESTS)
    + f"""SELECT r.session_id, a.avg_score,
  CASE WHEN a.avg_score IS NULL THEN {quoted(fixed.REPORT_NO_HISTORY)} END AS report
FROM requests r LEFT JOIN (SELECT session_id, {sql_avg("score")} AS avg_score FROM history GROUP BY 1) a USING (session_id)""",
)
def report_or_empty(spark, folder):
    out = h.report_or_empty(views.requests(spark, folder), views.history(spark, folder))
    return out.select("session_id", "avg_score", "report")


@query(
    "e2_number_sessions",
    with_views(HISTORY)
    + """SELECT session_id, timestamp, row_number() OVER (ORDER BY timestamp DESC, session_id) AS session_no
FROM (SELECT session_id, max(timestamp) AS timestamp FROM history GROUP BY 1)""",
)
def number_sessions(spark, folder):
    return h.number_sessions(h.session_list(views.history(spark, folder)))


@query(
    "e3_number_questions",
    with_views(HISTORY)
    + """SELECT id, session_id,
  row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, id DESC) AS question_no FROM history""",
)
def number_questions(spark, folder):
    return h.number_questions(views.history(spark, folder)).select("id", "session_id", "question_no")


ADAPTIVE_SQL = (
    with_views(HISTORY)
    + f"""SELECT id, session_id, recent_avg, {sql_tier("recent_avg")} AS tier FROM (
  SELECT id, session_id, {sql_avg("score", "OVER last")} AS recent_avg FROM history
  WINDOW last AS (PARTITION BY session_id ORDER BY timestamp, id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
)


@query("e6_adaptive_trace", ADAPTIVE_SQL)
def adaptive_trace(spark, folder):
    out = h.adaptive_trace(views.history(spark, folder))
    return out.select("id", "session_id", "recent_avg", "tier")


@query("f1_order_history", with_views(HISTORY) + "SELECT * FROM history ORDER BY timestamp DESC, id DESC")
def order_history(spark, folder):
    return h.order_history(views.history(spark, folder))


@query("b2_filter_session", with_views(HISTORY) + "SELECT * FROM history WHERE session_id = 7")
def filter_session(spark, folder):
    return h.filter_session(views.history(spark, folder), 7)


@query(
    "f2_latest",
    with_views(HISTORY) + "SELECT * FROM history WHERE session_id = 7 ORDER BY timestamp DESC, id DESC LIMIT 3",
)
def latest(spark, folder):
    return h.latest(views.history(spark, folder), 7)


@query(
    "p5_report_prompt",
    with_views(HISTORY, REQUESTS)
    + f"""SELECT session_id, profile_name, role, count(*) AS requests, any_value(avg_score) AS avg_score,
  1::BIGINT AS part_no, any_value({sql_fill(
      fixed.REPORT_PROMPT, profile_name="profile_name", role="role", average="printf('%.1f', avg_score)", history="text"
  )}) AS prompt
FROM requests JOIN (
  SELECT session_id, {sql_avg("score")} AS avg_score,
    string_agg({sql_fill(fixed.HISTORY_LINE, question="question", score="score")}, chr(10)
               ORDER BY timestamp, id) AS text
  FROM history GROUP BY session_id) USING (session_id)
GROUP BY session_id, profile_name, role""",
)
def report_prompt(spark, folder):
    return h.report_prompt(views.requests(spark, folder), views.history(spark, folder), PART_BYTES)


@query(
    "h32_one_decimal",
    """SELECT o_orderkey, printf('%.1f', o_totalprice / 1000) AS shown, l.user_id, l.avg_display
FROM orders LEFT JOIN (SELECT user_id, printf('%.1f', value / 10) AS avg_display, event_id FROM events) l
  ON o_orderkey = l.event_id""",
)
def one_decimal(spark, folder):
    orders = views.table(spark, folder, "orders").select(
        "o_orderkey", text.one_decimal(F.col("o_totalprice") / 1000).alias("shown")
    )
    scores = views.table(spark, folder, "events").select(
        F.col("event_id").alias("o_orderkey"), "user_id", text.one_decimal(F.col("value") / 10).alias("avg_display")
    )
    return orders.join(scores, "o_orderkey", "left")


@query("h33_local_time", "SELECT event_id, strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown FROM events")
def local_time(spark, folder):
    return views.table(spark, folder, "events").select("event_id", text.local_time(F.col("ts")).alias("shown"))


@query(
    "h34_session_uuid",
    "SELECT count(*) AS rows, count(*) AS ids, 36::BIGINT AS shortest, 36::BIGINT AS longest FROM customer",
)
def session_uuid(spark, folder):
    ids = views.requests(spark, folder).select(text.session_uuid().alias("u"))
    size = F.length("u").cast("bigint")
    return ids.agg(
        F.count("u").alias("rows"), F.countDistinct("u").alias("ids"), F.min(size).alias("shortest"),
        F.max(size).alias("longest"),
    )


# ---- the score table ------------------------------------------------------------------------------

ORDER = ["timestamp", "session_id", "question", "score"]


def new_table(spark, label):
    """A fresh table in a database of the shared folder."""
    path = fresh_path(spark, label)
    name = f"prepbank_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    score_log.init_history(spark, f"{name}.history")
    return f"{name}.history"


def logged(spark, table):
    out = score_log.read_history(spark, table)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "a5_init_history",
    with_views(HISTORY)
    + """SELECT CAST(session_id AS VARCHAR) AS session_id, count(*) AS rows, min(score) AS lowest FROM history
GROUP BY session_id""",
)
def init_history(spark, folder):
    table = new_table(spark, "init")
    score_log.log_scores(views.history(spark, folder), table, ORDER)
    score_log.init_history(spark, table)
    return spark.table(table).groupBy("session_id").agg(F.count("id").alias("rows"), F.min("score").alias("lowest"))


@query(
    "a6_log_scores",
    with_views(HISTORY)
    + """SELECT row_number() OVER (ORDER BY question >= 'p', timestamp, session_id, question, score) AS id,
  CAST(session_id AS VARCHAR) AS session_id, question, score, timestamp FROM history""",
)
def log_scores(spark, folder):
    table, rows = new_table(spark, "log"), views.history(spark, folder)
    score_log.log_scores(rows.where(F.col("question") < "p"), table, ORDER)
    score_log.log_scores(rows.where(F.col("question") >= "p"), table, ORDER)
    return logged(spark, table)


@query(
    "a7_clear_history",
    with_views(HISTORY)
    + """SELECT (SELECT count(*) FROM history) + row_number() OVER (ORDER BY timestamp, session_id, question, score) AS id,
  CAST(session_id AS VARCHAR) AS session_id, question, score, timestamp FROM history""",
)
def clear_history(spark, folder):
    table, rows = new_table(spark, "clear"), views.history(spark, folder)
    score_log.log_scores(rows, table, ORDER)
    score_log.clear_history(spark, table)
    score_log.log_scores(rows, table, ORDER)
    return logged(spark, table)
