"""The flow from request to question, with several requests of one session."""

import datetime

import pytest
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.operators import retrieve
from prepbank.plans import flows
from prepbank.session import materialize


def test_next_question(spark):
    questions = ["join tables in sql", "window functions in sql", "train a neural net", "tune a neural model"]
    index = spark.createDataFrame(
        [(f"q_{i}", "AI Engineer", q, f"answer {i}", q) for i, q in enumerate(questions)],
        "id string, role string, question string, model_answer string, text string",
    )
    asked = spark.createDataFrame(
        [(1, "s", "AI Engineer", "neural model"), (2, "s", "AI Engineer", "sql join"), (3, "t", "AI Engineer", "sql"),
         (4, "u", "Nobody", "sql")],
        "request bigint, session_id string, role string, text string",
    )
    asked = asked.select(
        "*", F.lit("Ann").alias("profile_name"), F.lit("Mid").alias("experience"), F.col("text").alias("resume"),
        F.lit(None).cast("string").alias("question_type"),
    )
    history = spark.createDataFrame(
        [(1, "s", 9.0), (2, "s", 8.0), (3, "s", 8.0), (4, "s", 8.0)], "id bigint, session_id string, score double"
    ).withColumn("timestamp", F.timestamp_seconds("id"))

    near = flows.retrieved_questions(retrieve.embed(asked), retrieve.embed(index), 2, "request").cache()
    top = {(r["request"], r["rank"]): r["question"] for r in near.collect()}
    assert top[1, 1] == "tune a neural model" and top[2, 1] == "join tables in sql"
    assert {request for request, _ in top} == {1, 2, 3}

    prompts = {r["request"]: r for r in flows.question_prompts(asked, near, history, request_id="request").collect()}
    assert {k: r["recent_avg"] for k, r in prompts.items()} == {1: 8.0, 2: 8.0, 3: 5.0}
    assert fixed.TIER_HARDER in prompts[1]["prompt"] and fixed.TIER_HARDER not in prompts[3]["prompt"]
    assert "- tune a neural model" in prompts[1]["prompt"] and "Focus: Technical\n" in prompts[1]["prompt"]

    generated = spark.createDataFrame(
        [(1, '```json\n{"question": "New?", "model_answer": "Yes."}\n```'), (2, '{"question": "New?"}')],
        "request bigint, raw string",
    )
    got = {r["request"]: r for r in flows.generated_or_static(near, generated, request_id="request").collect()}
    assert (got[1]["question"], got[1]["model_answer"], got[1]["source"]) == ("New?", "Yes.", "generated")
    for request in (2, 3):
        assert got[request]["source"] == "static-rag"
        assert got[request]["question"] in {q for (r, _), q in top.items() if r == request}


    # Ids alone, and the texts of what is shown from the bank: the same prompts and questions.
    slim = flows.nearest_questions(retrieve.embed(asked), retrieve.embed(index), 2, "request")
    assert slim.columns == ["request", "id", "distance", "rank"]
    late = {r["request"]: r["prompt"] for r in flows.question_prompts(asked, slim, history, request_id="request", bank=index).collect()}
    assert late == {k: r["prompt"] for k, r in prompts.items()}
    later = {r["request"]: r for r in flows.generated_or_static(slim, generated, request_id="request", bank=index).collect()}
    assert later == got


def test_reports(spark):
    requests = spark.createDataFrame([("s",), ("t",), ("u",)], "session_id string")
    history = spark.createDataFrame([("s", 4.0), ("s", 5.0), ("u", 1.0)], "session_id string, score double")
    responses = spark.createDataFrame([("s", 'x {"weak_areas": ["a"], "study_plan": []}'), ("t", "{}")], "session_id string, raw string")
    got = {r["session_id"]: (r["report"], r["average_score"]) for r in flows.reports(requests, history, responses).collect()}
    assert got == {
        "s": ("Top Weak Areas:\n* a\n\nQuick Study Plan:", 4.5),
        "t": (fixed.REPORT_NO_HISTORY, None),
        "u": (fixed.REPORT_NO_RESPONSE, 1.0),
    }


HISTORY = "id bigint, session_id string, question string, score double, timestamp timestamp"


def page_by_hand(rows):
    """(session, its number, average, question number, question, score), sessions and questions newest first."""
    sessions = {}
    for r in rows:
        sessions.setdefault(r[1], []).append(r)
    stamps = sorted(sessions, key=lambda s: (-max(r[4] for r in sessions[s]).timestamp(), s is not None, s or ""))
    out = []
    for no, s in enumerate(stamps, 1):
        scores = [r[3] for r in sessions[s] if r[3] is not None]
        shown = f"{sum(scores) / len(scores):.1f}" if scores else "0"
        newest = sorted(sessions[s], key=lambda r: (r[4], r[0]), reverse=True)
        out += [(s, no, shown, i, r[2], r[3]) for i, r in enumerate(newest, 1) if s is not None]
    return sorted(out, key=str)


def page(df):
    return sorted(
        [(r["session_id"], r["session_no"], r["avg_display"], r["question_no"], r["question"], r["score"]) for r in df.collect()], key=str
    )


@pytest.mark.parametrize("limit", [None, 3, 1_000_000])
def test_session_page(spark, limit):
    """Hot sessions, rows without a session, a question or a score, and rows that come twice."""
    day = datetime.datetime(2024, 5, 1)
    rows = [
        (i, [None, "hot", "a", "b", "hot", "hot", f"s{i % 4}"][i % 7], None if i % 11 == 0 else f"q{i}", None if i % 5 == 0 else i % 9 / 2, day + datetime.timedelta(minutes=i * 7 % 40))
        for i in range(80)
    ]
    rows += [(90, "alone", "x", None, day), rows[1], rows[2], rows[2]]
    got = flows.session_page(spark.createDataFrame(rows, HISTORY).repartition(4), limit)
    assert page(got) == page_by_hand(rows) and got.where("message is not null").count() == 0


def test_session_page_without_history(spark):
    got = flows.session_page(spark.createDataFrame([], HISTORY)).collect()
    assert [r["message"] for r in got] == [fixed.PAGE_NO_HISTORY] and got[0]["session_id"] is None


def test_session_page_groups_the_history_once(spark, monkeypatch):
    """Of the history the page reads its rows and whether there are any; all else comes from one row per session, grouped ahead."""
    stamp = datetime.datetime(2024, 5, 1)
    history = materialize(spark.createDataFrame([(i, f"s{i % 5}", "q", 1.0, stamp) for i in range(20)], HISTORY), "history")
    grouped = []
    group = type(history).groupBy
    monkeypatch.setattr(type(history), "groupBy", lambda self, *cols: grouped.append(bool(cols) and "question" in self.columns) or group(self, *cols))
    got = flows.session_page(history)
    assert grouped.count(True) == 1
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [id#") == 2
    assert got.count() == 20
