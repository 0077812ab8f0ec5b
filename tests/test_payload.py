"""JSON recovery and what is rendered from it."""

import json
import random

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import jsons, payload, prompts


def over(spark, inputs, fn):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, raw string")
    return [r["o"] for r in rows.select("i", fn(F.col("raw")).alias("o")).orderBy("i").collect()]


def valid(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_parse_json_takes_whole_values_only(spark):
    inputs = [
        '{"a":1}', ' {"a":1}\n', '{"a":1} x', '{"a":1}]', '{"a":1}]}', '{"a":1}}', '{"a":1}],"b":[1', '1,2', '1,"x":2',
        "1]", "1}", "[1]", "[1],[2]", '"x"', "", " ", "{'a':1}", "nul", "null", '{"a":{"b":1}} y }', '{"a":01}',
        '1],"x":[1', '"a":1', '{}', '{}{}', '[]]', '{"a":"}"}', '1}, {"v":1',
    ]
    rng = random.Random(3)
    inputs += ["".join(rng.choices('{}[]",:1a ', k=rng.randrange(1, 9))) for _ in range(1500)]
    got = over(spark, inputs, lambda c: jsons.parse_json(c).isNotNull())
    assert got == [valid(x) for x in inputs]


def test_json_text(spark):
    got = over(
        spark, ['x {"a":{"b":1}} y } z', "```json\n[1]\n```", "} {", "a {b", "", "p {\n} q"], payload.json_text
    )
    assert got == ['{"a":{"b":1}} y }', "[1]", "} {", "a {b", "", "{\n}"]


def test_scores_and_outcomes(spark):
    cases = {
        "{}": (5.0, "parsed"),
        '{"score":"8"}': (8.0, "parsed"),
        '{"score":8.5}': (8.5, "parsed"),
        '{"score":-3}': (-3.0, "parsed"),
        '{"score":"8/10"}': (None, "parse_error"),
        '{"score":null}': (None, "parse_error"),
        '{"score":[1]}': (None, "parse_error"),
        "[1]": (None, "parse_error"),
        'x {"a":{"b":1}} y } z': (None, "parse_error"),
        'ok {"score": 9} bye': (9.0, "parsed"),
        "": (None, "no_response"),
        None: (None, "no_response"),
    }
    got = over(spark, list(cases), payload.evaluate)
    assert [(r["score"], r["outcome"]) for r in got] == list(cases.values())
    mock = over(spark, ["", "{}"], lambda c: payload.evaluate(c, F.lit(False)))
    assert [(r["score"], r["outcome"]) for r in mock] == [(7.0, "mock")] * 2


def test_evaluation_fields(spark):
    got = over(spark, [fixed.MOCK_EVALUATION, '{"strengths": "one"}'], lambda c: payload.evaluation(payload.recover_json(c)))
    assert got[0].asDict() == {
        "score": 7.0, "summary": "Mock summary.", "strengths": ["Mock strength"], "weaknesses": ["Mock weakness"],
        "improvement_tips": ["Mock tip"], "improved_answer": "Mock improved answer.",
    }
    assert got[1].asDict() == {
        "score": 5.0, "summary": "", "strengths": [], "weaknesses": [], "improvement_tips": [], "improved_answer": "",
    }


def test_fences_only_recovery(spark):
    got = over(
        spark,
        ['```json\n{"question":"q","model_answer":"a"}\n```', 'see {"question":"q"}', '{"question":"q"}'],
        payload.generated_question,
    )
    assert [r and (r["question"], r["model_answer"]) for r in got] == [("q", "a"), (None, None), ("q", None)]


def test_report_text(spark):
    got = over(
        spark,
        ['x {"weak_areas":["a","b"],"study_plan":["c"]}', "{}", '{"weak_areas":3}', "plain", "", None],
        payload.report_text,
    )
    assert got == [
        "Top Weak Areas:\n* a\n* b\n\nQuick Study Plan:\n- c",
        "Top Weak Areas:\n\nQuick Study Plan:",
        '{"weak_areas":3}',
        "plain",
        fixed.REPORT_NO_RESPONSE,
        fixed.REPORT_NO_RESPONSE,
    ]


def test_strategy_text(spark):
    long = F.lit("a long enough background")
    raws = ['{"strategy_bullets":["a","b"]}', "{}", "{bad}", '{"strategy_bullets":null}', ""]
    got = over(spark, raws, lambda c: payload.strategy_text(long, c))
    assert got == ["* a\n* b", "", fixed.STRATEGY_BAD_PARSE, fixed.STRATEGY_BAD_PARSE, fixed.STRATEGY_NO_RESPONSE]
    assert over(spark, raws[:1], lambda c: payload.strategy_text(F.lit(" short "), c)) == [fixed.SHORT_BACKGROUND]
    assert over(spark, raws[:1], lambda c: payload.strategy_text(long, c, F.lit(False))) == [fixed.STRATEGY_NO_KEY]


def test_prompts_fill_their_templates(spark):
    row = spark.range(1).select(
        prompts.question(
            F.lit("Ann"), F.lit("Mid"), F.lit("AI Engineer"), F.lit(None), F.lit("cv {x}"), F.lit("- q"), F.lit(8.0)
        ).alias("q"),
        prompts.report(F.lit("Ann"), F.lit("AI Engineer"), F.lit(6.25), F.lit("Q: a | Score: 6.25/10")).alias("r"),
        prompts.frame(F.lit("q?"), F.array(F.lit(" a "), F.lit("")), F.lit("Mid"), F.lit("AI Engineer")).alias("f"),
    ).first()
    wanted = fixed.QUESTION_PROMPT.format(
        profile_name="Ann", experience="Mid", role="AI Engineer", question_type="Technical", resume="cv {x}",
        reference_questions="- q", tier=fixed.TIER_HARDER,
    )
    assert row["q"] == wanted
    assert "Average Score: 6.2/10\nSession History:\nQ: a | Score: 6.25/10\n\n" in row["r"]
    assert "key points:\n- a\n\nUsing" in row["f"]
