"""Score history: last-n averages, tiers, session summaries, nested histories and transcripts.

A history has columns ``id, session_id, question, score, timestamp``. The order within a session is
(timestamp, id), so equal stamps do not make results vary.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import prompts
from prepbank.functions.exact import average, exact_avg, exact_sum, sum_parts
from prepbank.functions.template import fill
from prepbank.functions.text import difficulty_tier, one_decimal, score_repr
from prepbank.operators.ordering import (
    MAX_GROUP_BYTES,
    MAX_GROUP_ROWS,
    cut,
    first_rows,
    lookup,
    number_rows,
    rolling,
    text_parts,
)


def newest_first():
    return [F.desc("timestamp"), F.desc("id")]


def oldest_first():
    return [F.asc("timestamp"), F.asc("id")]


# ---- filters and sorts ---------------------------------------------------------------------


def filter_session(history: DataFrame, sid) -> DataFrame:
    return history.where(F.col("session_id") == F.lit(sid))


def order_history(history: DataFrame, asc: bool = False) -> DataFrame:
    return history.orderBy(*(oldest_first() if asc else newest_first()))


def latest(history: DataFrame, sid, n: int = fixed.RECENT_SCORES) -> DataFrame:
    """Latest n rows of one session."""
    return filter_session(history, sid).orderBy(*newest_first()).limit(n)


# ---- last-n ------------------------------------------------------------------------------------


def recent_scores(history: DataFrame, n: int = fixed.RECENT_SCORES) -> DataFrame:
    """Latest n rows of every session, ``recency`` 1 = newest.

    Spark keeps n rows per session in each input task before the shuffle, so a hot session ships little.
    """
    return first_rows(history, ["session_id"], newest_first(), n, "recency")


def recent_avg(history: DataFrame, n: int = fixed.RECENT_SCORES) -> DataFrame:
    """Average of the latest n scores of every session that has any."""
    picked = recent_scores(history.select("session_id", "timestamp", "id", "score"), n)
    return picked.groupBy("session_id").agg(exact_avg(F.col("score")).alias("recent_avg"))


def with_recent_avg(
    requests: DataFrame,
    history: DataFrame,
    n: int = fixed.RECENT_SCORES,
    default: float = fixed.DEFAULT_AVERAGE,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Requests with their session's last-n average, the default for sessions without scores."""
    joined = lookup(requests, recent_avg(history, n), ["session_id"], "left", max_group_rows)
    return joined.withColumn("recent_avg", F.coalesce("recent_avg", F.lit(default)))


def with_tier(requests: DataFrame, history: DataFrame, **options) -> DataFrame:
    return with_recent_avg(requests, history, **options).withColumn("tier", difficulty_tier(F.col("recent_avg")))


def adaptive_trace(
    history: DataFrame, n: int = fixed.RECENT_SCORES, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """The last-n average and tier as they stood after every answer."""
    parts = sum_parts(F.col("score"))
    traced = rolling(history, ["session_id"], oldest_first(), n, parts, max_group_rows)
    traced = traced.withColumn("recent_avg", average(*map(F.col, parts))).drop(*parts)
    return traced.withColumn("tier", difficulty_tier(F.col("recent_avg")))


# ---- summaries ------------------------------------------------------------------------------------


def session_avg(history: DataFrame) -> DataFrame:
    return history.groupBy("session_id").agg(exact_avg(F.col("score")).alias("avg_score"))


def session_summary(history: DataFrame, **more: Column) -> DataFrame:
    """Total, count, average and its one-decimal display for every session. ``more`` are further aggregates that come by the same
    grouping, so that a caller does not group the history again."""
    out = history.groupBy("session_id").agg(
        exact_sum(F.col("score")).alias("total_score"), F.count("score").alias("questions"), *[c.alias(n) for n, c in more.items()]
    )
    avg = F.when(F.col("questions") > 0, F.col("total_score") / F.col("questions")).otherwise(0.0)
    out = out.withColumn("avg_score", avg)
    return out.withColumn("avg_display", F.when(F.col("questions") > 0, one_decimal(F.col("avg_score"))).otherwise("0"))


def session_list(history: DataFrame) -> DataFrame:
    """One row per session with the stamp of its newest row; also of rows that hold each session's newest stamp already."""
    return history.groupBy("session_id").agg(F.max("timestamp").alias("timestamp"))


def number_sessions(sessions: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Session numbers over a session list, newest = 1; equal stamps go by session."""
    order = [F.desc("timestamp"), F.asc("session_id")]
    return number_rows(sessions, [], order, "session_no", max_group_rows=max_group_rows)


def number_questions(history: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Question numbers inside each session, newest = 1."""
    return number_rows(history, ["session_id"], newest_first(), "question_no", max_group_rows=max_group_rows)


def history_items(
    history: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """One row per answer, at any size of a session: the session with its newest stamp, the question's number
    (newest = 1), text, score and stamp. Sorted by (timestamp descending, session_id, question_no) it is the whole history page.
    ``sizes`` are the sessions' ready counts ``session_id, _rows``."""
    newest = {"_newest": F.col("timestamp")}
    numbered = number_rows(history, ["session_id"], newest_first(), "question_no", newest, max_group_rows, sizes)
    return numbered.select(
        "session_id", F.col("_newest").alias("timestamp"), "question_no", "question", "score",
        F.col("timestamp").alias("answered"),
    )


def history_lines(history: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Transcript as rows ``session_id, line_no, line``, oldest first, at any size of a session."""
    return number_rows(_lines(history), ["session_id"], oldest_first(), "line_no", max_group_rows=max_group_rows).select(
        "session_id", "line_no", "line"
    )


def _lines(history: DataFrame) -> DataFrame:
    line = fill(fixed.HISTORY_LINE, question=F.col("question"), score=score_repr(F.col("score")))
    return history.select("session_id", "timestamp", "id", line.alias("line"))


def history_nested(history: DataFrame, part_bytes: int, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """``history_items`` nested, newest first; sessions newest first. An array holds about ``part_bytes`` of questions;
    the arrays of a session by ``part_no``, one after the other, hold every row."""
    rows = history.select("session_id", "id", "question", "score", "timestamp")
    size = F.octet_length(F.coalesce("question", F.lit(""))) + 24
    numbered = cut(rows, ["session_id"], newest_first(), size, part_bytes, max_group_bytes)
    item = F.struct("_no", F.struct("question", "score", "timestamp").alias("item"))
    grouped = numbered.groupBy("session_id", "part_no").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    grouped = lookup(grouped, session_list(history), ["session_id"], "inner", max(1, max_group_bytes // part_bytes))
    ordered = grouped.orderBy(F.desc("timestamp"), "session_id", "part_no")
    return ordered.select(
        "session_id", "timestamp", "part_no", F.transform("_items", lambda x: x["item"]).alias("questions")
    )


def history_text(history: DataFrame, part_bytes: int, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """``history_lines`` joined to texts, in parts of about ``part_bytes``."""
    return _history_parts(history, part_bytes, max_group_bytes).drop("_first", "_last")


def _history_parts(history, part_bytes, max_group_bytes):
    parts = text_parts(_lines(history), ["session_id"], oldest_first(), "line", part_bytes, max_group_bytes)
    return parts.withColumnRenamed("line", "history")


# ---- reports ----------------------------------------------------------------------------------------


def report_or_empty(requests: DataFrame, history: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Requests with their session average, and the fixed message where a session has no scores."""
    joined = lookup(requests, session_avg(history), ["session_id"], "left", max_group_rows)
    return joined.withColumn("report", F.when(F.col("avg_score").isNull(), fixed.REPORT_NO_HISTORY))


def report_prompt(
    requests: DataFrame, history: DataFrame, part_bytes: int, max_group_bytes: int = MAX_GROUP_BYTES
) -> DataFrame:
    """One report prompt for each session with scores and each profile and role that ask for it, with the number of requests.

    The prompt is over the whole history. It comes in parts of about ``part_bytes`` of history: the parts by
    ``part_no``, joined with newlines, are the prompt.
    """
    asked = requests.groupBy("session_id", "profile_name", "role").agg(F.count(F.lit(1)).alias("requests"))
    asked = asked.join(session_avg(history), "session_id")
    texts = _history_parts(history, part_bytes, max_group_bytes)
    # Parts are fat rows: a session is hot here once it has max_group_bytes of them.
    joined = lookup(texts, asked, ["session_id"], "inner", max(1, max_group_bytes // part_bytes))
    head, tail = prompts.report_frame(F.col("profile_name"), F.col("role"), F.col("avg_score"))
    prompt = F.concat(
        F.when(F.col("_first"), head).otherwise(""), F.col("history"), F.when(F.col("_last"), tail).otherwise("")
    )
    return joined.select("session_id", "profile_name", "role", "requests", "avg_score", "part_no", prompt.alias("prompt"))
