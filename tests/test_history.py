"""Score history: the plain plans against Python, and the split plans of hot sessions against the plain ones."""

import datetime as dt
import random
from decimal import Decimal
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.operators import history as h
from prepbank.operators import ordering

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log():
    """600 rows over 12 sessions; one holds a third of them, and many share a stamp."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        sid = 0 if i % 3 == 0 else rng.randrange(1, 12)
        stamp = START + dt.timedelta(seconds=rng.randrange(60))
        rows.append((i, sid, f"q{rng.randrange(9)}", rng.randrange(0, 101) / 10, stamp))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def history(spark, log):
    return spark.createDataFrame(log, "id bigint, session_id bigint, question string, score double, timestamp timestamp")


def by_session(log):
    out = {}
    for row in sorted(log, key=lambda r: (r[4], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


# Sessions over 40 rows count as hot: session 0, and a few of the others.
SPLITS = [ordering.MAX_GROUP_ROWS, 40, 7]


@pytest.mark.parametrize("limit", SPLITS)
def test_number_questions(history, log, limit):
    got = h.number_questions(history, limit).select("id", "question_no").collect()
    wanted = {}
    for rows in by_session(log).values():
        wanted.update({row[0]: no for no, row in enumerate(reversed(rows), 1)})
    assert len(got) == len(log) and dict(got) == wanted


@pytest.mark.parametrize("limit", SPLITS)
@pytest.mark.parametrize("n", [1, 3, 10])
def test_adaptive_trace(history, log, limit, n):
    got = {r["id"]: (round(r["recent_avg"], 9), r["tier"]) for r in h.adaptive_trace(history, n, limit).collect()}
    wanted = {}
    for rows in by_session(log).values():
        for at, row in enumerate(rows):
            last = [r[3] for r in rows[max(0, at - n + 1) : at + 1]]
            avg = sum(last) / len(last)
            tier = "easier" if avg < 5 else "harder" if avg >= 8 else "none"
            wanted[row[0]] = (round(avg, 9), tier)
    assert got == wanted


# Bounds in bytes: none reached, one hot session, every session far past both.
BYTES = [(1 << 24, ordering.MAX_GROUP_BYTES), (1 << 24, 2000), (100, 2000), (100, 60), (1, 1)]


@pytest.mark.parametrize("part, group", BYTES)
def test_history_nested(history, log, part, group):
    got = h.history_nested(history, part, group).collect()
    wanted = by_session(log)
    stamps = [r["timestamp"] for r in got]
    assert stamps == sorted(stamps, reverse=True)
    whole = {}
    for r in sorted(got, key=lambda r: r["part_no"]):
        assert r["timestamp"] == wanted[r["session_id"]][-1][4]
        assert len(r["questions"]) <= part // 27 + 1
        whole.setdefault(r["session_id"], []).extend((q["question"], q["score"], q["timestamp"]) for q in r["questions"])
    assert whole == {sid: [row[2:] for row in reversed(rows)] for sid, rows in wanted.items()}


@pytest.mark.parametrize("limit", SPLITS)
def test_history_as_rows_has_one_shape_at_any_size(history, log, limit):
    items = {(r["session_id"], r["question_no"]): r for r in h.history_items(history, limit).collect()}
    lines = {(r["session_id"], r["line_no"]): r["line"] for r in h.history_lines(history, limit).collect()}
    assert len(items) == len(lines) == len(log)
    for sid, rows in by_session(log).items():
        for no, row in enumerate(rows, 1):
            assert lines[sid, no] == f"Q: {row[2]} | Score: {row[3]}/10"
            item = items[sid, len(rows) + 1 - no]
            assert (item["question"], item["score"], item["answered"], item["timestamp"]) == (*row[2:], rows[-1][4])


@pytest.mark.parametrize("part, group", BYTES)
def test_history_text(history, log, part, group):
    whole = {}
    for r in sorted(h.history_text(history, part, group).collect(), key=lambda r: r["part_no"]):
        whole.setdefault(r["session_id"], []).append(r["history"])
    wanted = {
        sid: "\n".join(f"Q: {row[2]} | Score: {row[3]}/10" for row in rows) for sid, rows in by_session(log).items()
    }
    assert {sid: "\n".join(parts) for sid, parts in whole.items()} == wanted


@pytest.mark.parametrize("limit", SPLITS)
def test_number_sessions(history, log, limit):
    got = h.number_sessions(h.session_list(history), limit).collect()
    newest = {sid: rows[-1][4] for sid, rows in by_session(log).items()}
    wanted = sorted(newest, key=lambda sid: (-newest[sid].timestamp(), sid))
    assert [r["session_id"] for r in sorted(got, key=lambda r: r["session_no"])] == wanted
    assert sorted(r["session_no"] for r in got) == list(range(1, len(wanted) + 1))


def test_recent(spark, history, log):
    wanted = {sid: [r[3] for r in rows[-3:]] for sid, rows in by_session(log).items()}
    got = {r["session_id"]: r["recent_avg"] for r in h.recent_avg(history).collect()}
    assert got == {sid: pytest.approx(sum(x) / len(x)) for sid, x in wanted.items()}
    latest = [r["id"] for r in h.latest(history, 0, 5).collect()]
    assert latest == [r[0] for r in reversed(by_session(log)[0][-5:])]


@pytest.mark.parametrize("limit", SPLITS)
def test_tiers_of_requests_with_a_hot_session(spark, history, log, limit):
    """A third of the requests ask for one session; a session without scores keeps the default."""
    requests = spark.range(300).select(
        F.col("id").alias("request"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 20).alias("session_id")
    )
    got = h.with_tier(requests, history, max_group_rows=limit).collect()
    sessions = by_session(log)
    assert len(got) == 300
    for r in got:
        last = [x[3] for x in sessions.get(r["session_id"], [])[-3:]]
        assert r["recent_avg"] == pytest.approx(sum(last) / len(last) if last else 5.0)


@pytest.mark.parametrize("part, group", BYTES)
def test_report_prompts_cover_the_whole_history(spark, history, log, part, group):
    """One prompt a session at any size, and one for each role where a session is asked for in two."""
    requests = spark.range(14).select(
        F.col("id").alias("session_id"), F.lit("Ann").alias("profile_name"), F.lit("AI Engineer").alias("role")
    )
    again = requests.where("session_id = 0")
    requests = requests.unionByName(again).unionByName(again.withColumn("role", F.lit("Tester")))
    texts, asked = {}, {}
    for r in sorted(h.report_prompt(requests, history, part, group).collect(), key=lambda r: r["part_no"]):
        key = r["session_id"], r["role"]
        texts.setdefault(key, []).append(r["prompt"])
        asked[key] = r["requests"]
    sessions = by_session(log)
    assert set(texts) == {(sid, "AI Engineer") for sid in sessions} | {(0, "Tester")}
    assert {key for key, n in asked.items() if n == 2} == {(0, "AI Engineer")}
    for (sid, role), parts in texts.items():
        rows = sessions[sid]
        assert "\n".join(parts) == fixed.REPORT_PROMPT.format(
            profile_name="Ann", role=role, average=f"{sum(r[3] for r in rows) / len(rows):.1f}",
            history="\n".join(f"Q: {row[2]} | Score: {row[3]}/10" for row in rows),
        )


def test_empty_reports(spark, history):
    requests = spark.createDataFrame([(0,), (99,)], "session_id bigint")
    got = {r["session_id"]: r["report"] for r in h.report_or_empty(requests, history).collect()}
    assert got == {0: None, 99: fixed.REPORT_NO_HISTORY}


def test_summary_of_null_scores(spark):
    rows = spark.createDataFrame([("a", None), ("b", 2.5), ("b", 4.0)], "session_id string, score double")
    got = {r["session_id"]: r.asDict() for r in h.session_summary(rows).collect()}
    assert (got["a"]["questions"], got["a"]["avg_score"], got["a"]["avg_display"]) == (0, 0.0, "0")
    assert (got["b"]["total_score"], got["b"]["avg_score"], got["b"]["avg_display"]) == (6.5, 3.25, "3.2")


def test_null_keys_stay(spark):
    """A null key is a group of its own, hot or not."""
    rows = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 4).alias("k"))
    for limit in (1000, 10):
        got = ordering.number_rows(rows, ["k"], [F.asc("id")], max_group_rows=limit).collect()
        nulls = sorted((r["id"], r["row_no"]) for r in got if r["k"] is None)
        assert nulls == [(i, n) for n, i in enumerate(range(1, 50, 2), 1)]
        assert len(got) == 50


def test_hot_keys_are_found_largest_first(spark):
    rows = spark.range(100).select((F.col("id") % 3 * (F.col("id") % 2)).alias("k"))
    hot = ordering.find_hot_keys(rows, ["k"], 20)
    assert [r["k"] for r in hot.frame.collect()] == [0] and hot.rows == 67
    assert ordering.find_hot_keys(rows, ["k"], 67) is None


def test_more_hot_keys_than_a_list_takes(history, log, monkeypatch):
    """Hot keys as a table of their own, with nothing broadcast: the same rows."""
    monkeypatch.setattr(ordering, "HOT_KEY_LIMIT", 1)
    monkeypatch.setattr(ordering, "BROADCAST_BYTES", 1)
    test_number_questions(history, log, 7)
    test_adaptive_trace(history, log, 7, 3)
    test_history_nested(history, log, 100, 60)
    test_history_as_rows_has_one_shape_at_any_size(history, log, 7)


def test_lookup_of_hot_keys_past_the_broadcast_bound(spark, history, log, monkeypatch):
    for limit in (1, 10_000):
        monkeypatch.setattr(ordering, "HOT_KEY_LIMIT", limit)
        monkeypatch.setattr(ordering, "BROADCAST_BYTES", 1)
        test_tiers_of_requests_with_a_hot_session(spark, history, log, 7)


def test_averages_do_not_depend_on_the_order_of_addition(spark):
    """Averages that are x.x5 or a bound of a tier, from scores whose sum as doubles depends on the order: one answer at any partitioning."""
    rng = random.Random(11)
    rows, wanted = [], {}
    for sid, target in enumerate(["26.15", "5", "8", "0.25", "7.35", "4.95", "2.65", "1e7"] * 6):
        n = rng.choice([3, 10, 27, 40])
        scores = [Decimal(rng.randrange(0, 10_000)) / 1000 for _ in range(n - 1)]
        scores.append(Decimal(target) * n - sum(scores))
        avg = float(sum(scores)) / n
        wanted[sid] = (float(sum(scores)), avg, f"{avg:.1f}")
        rows += [(len(rows) + i, sid, "q", float(s), START + dt.timedelta(seconds=i)) for i, s in enumerate(scores)]
    unstable = 0
    for sid in wanted:
        given = [r[3] for r in rows if r[1] == sid]
        unstable += len({reduce(add, x) for x in (given, given[::-1], sorted(given))}) > 1
    assert unstable > 5
    schema = "id bigint, session_id bigint, question string, score double, timestamp timestamp"
    answers = []
    for parts in (1, 2, 3, 7, 16):
        rng.shuffle(rows)
        history = spark.createDataFrame(rows, schema).repartition(parts)
        for r in h.session_summary(history).collect():
            assert (r["total_score"], r["avg_score"], r["avg_display"]) == wanted[r["session_id"]]
        assert {r["session_id"]: r["avg_score"] for r in h.session_avg(history).collect()} == {s: a for s, (_, a, _) in wanted.items()}
        answers.append((
            sorted(map(tuple, h.recent_avg(history, 3).collect())),
            sorted(map(tuple, h.adaptive_trace(history, 5, 20).select("id", "recent_avg", "tier").collect())),
        ))
    assert all(a == answers[0] for a in answers)


def test_averages_of_odd_scores(spark):
    rows = [("a", float("inf")), ("a", 1.0), ("b", float("nan")), ("c", 1e300), ("c", 1e300), ("d", -1e-9), ("e", None)]
    got = {r[0]: r[1] for r in h.session_avg(spark.createDataFrame(rows, "session_id string, score double")).collect()}
    assert got["a"] == float("inf") and got["b"] != got["b"] and got["c"] == 1e300 and got["d"] == -1e-9 and got["e"] is None
