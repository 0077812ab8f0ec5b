"""Bank construction."""

import pytest
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.operators import bank as b
from prepbank.plans import flows

SCRIPT = '<html><script type="application/json">{}</script></html>'


def pages(spark, *bodies):
    return spark.createDataFrame([(i, "u", SCRIPT.format(x)) for i, x in enumerate(bodies)], "page_id int, url string, html string")


def topics(spark, rows):
    return spark.createDataFrame(rows, "role string, pos bigint, question string, model_answer string")


def test_extract_questions(spark):
    got = b.extract_questions(
        pages(
            spark,
            '["1. What is a _join_ in SQL?", "short?", "no marker in this text", 5]',
            '["What is a *join* in SQL?", "Explain the loss of a net ?"]',
            "broken [",
            '{"q": "is this a question?"}',
        )
    )
    assert sorted(r[0] for r in got.collect()) == ["Explain the loss of a net ?", "What is a join in SQL?"]


def test_build_bank_puts_extracted_rows_first(spark):
    extracted = spark.createDataFrame([("Zeta model?",), ("Alpha model?",), ("What is SQL?",), ("Other?",)], "question string")
    curated = topics(
        spark,
        [("Machine Learning Engineer", i, f"Explain topic {i}", f"a{i}") for i in range(4)]
        + [("Machine Learning Engineer", 9, "Explain topic 0", "late"), ("Machine Learning Engineer", 10, "Zeta model?", "x")]
        + [("Data Scientist", 0, "What is CLT?", "b")],
    )
    got = b.build_bank(extracted, curated, 5).orderBy("role", "place").collect()
    ml = [r for r in got if r["role"] == "Machine Learning Engineer"]
    assert [r["question"] for r in ml] == ["Alpha model?", "Zeta model?", "Explain topic 0", "Explain topic 1", "Explain topic 2"]
    assert ml[0].asDict() == {
        "role": "Machine Learning Engineer", "category": "Core Concept", "question": "Alpha model?",
        "answer_strategy": "Flow Driven", "tags": ["Machine Learning Engineer", "Concepts"], "difficulty": "medium",
        "model_answer": fixed.EXTRACTED_ANSWER.replace("{question}", "Alpha model?"), "place": 1,
    }
    assert (ml[2]["model_answer"], ml[2]["difficulty"], ml[2]["answer_strategy"]) == ("a0", "medium", "Direct Answer")
    ds = [r for r in got if r["role"] == "Data Scientist"]
    assert [(r["question"], r["difficulty"], r["answer_strategy"]) for r in ds] == [
        ("Other?", "medium", "Flow Driven"), ("What is CLT?", "hard", "STAR Method"),
    ]
    assert [r["question"] for r in got if r["role"] == "Data Analyst"] == ["What is SQL?"]


def test_padding_fills_every_templated_role(spark):
    curated = topics(
        spark,
        [("Data Scientist", i, f"q{i}", "a") for i in range(40)] + [("Data Analyst", i, f"q{i}", "a") for i in range(150)]
        + [("Machine Learning Engineer", i, f"q{i}", "a") for i in range(3)],
    )
    padded = b.pad_to_quota(curated)
    assert {r["role"]: r["count"] for r in padded.groupBy("role").count().collect()} == {
        "Data Scientist": 150, "Data Analyst": 150, "AI Engineer": 150, "Machine Learning Engineer": 3,
    }
    first = padded.where("role = 'Data Scientist' and pos = 40").first()
    assert first["question"] == "Explain data science methodology option 41 for experiment design."
    last = padded.where("role = 'AI Engineer' and pos = 149").first()
    assert "optimization 150." in last["model_answer"]


def test_standard_bank_has_750_rows(spark):
    """Four roles of 150, with nothing extracted, and 150 behavioural rows."""
    curated = topics(
        spark,
        [(role, i, f"{role} {i}", "a") for role, n in zip(fixed.ROLES, (150, 40, 20, 20), strict=True) for i in range(n)],
    )
    soft = b.soft_skill_rows(spark.range(fixed.BEHAVIORAL_ROWS)).drop("id")
    bank = flows.bank_from_pages(pages(spark, "[]"), curated, soft).cache()
    counts = {r["role"]: (r["is_total"], r["n"]) for r in b.bank_counts(bank).collect()}
    assert counts[None] == (1, 750)
    assert bank.where("type IS NULL").groupBy("role").count().where("count <> 150").count() == 0
    assert bank.where("type IS NULL").groupBy("role", "question").count().where("count > 1").count() == 0


def test_soft_skill_rows(spark):
    rows = b.soft_skill_rows(spark.range(3000), seed=3).collect()
    themes = dict(fixed.THEMES)
    for r in rows:
        head, question = r["question"][1:].split("] ", 1)
        theme, rest = head.split(" - ", 1)
        assert themes[theme] == question and rest == f"{r['experience']} {r['role']}"
        assert f"relevant to a {r['experience']}-level {r['role']}." in r["model_answer"]
    assert len({r["question"] for r in rows}) == len(fixed.THEMES) * len(fixed.ROLES) * len(fixed.LEVELS)
    again = b.soft_skill_rows(spark.range(3000).repartition(7), seed=3).orderBy("id").collect()
    assert again == sorted(rows, key=lambda r: r["id"])
    assert b.soft_skill_rows(spark.range(3000), seed=4).orderBy("id").collect() != again


def test_template_grid(spark):
    grid = b.template_grid(b.theme_table(spark))
    assert grid.count() == 120 == grid.select("theme", "role", "experience").distinct().count()


def test_index_rows_have_defaults(spark):
    rows = spark.createDataFrame([("q_0", None, None, None, None)], "id string, role string, type string, question string, model_answer string")
    got = b.index_rows(rows).first()
    assert (got["document"], got["type"], got["model_answer"]) == ("Role: . Type: Technical. Question: ", "Technical", "")


def test_require_nonblank(spark):
    rows = spark.createDataFrame([("a", "b"), (" \n", "b"), ("a", None), ("a", "")], "x string, y string")
    assert b.require_nonblank(rows, "x", "y").count() == 1


@pytest.mark.parametrize("copies", [1, 500])
def test_copies_count_once(spark, copies):
    rows = topics(spark, [("r", i, "same", f"a{i}") for i in range(copies)] + [("r", 0, "other", "z")])
    got = b.first_occurrences(b.curated_rows(rows)).collect()
    assert sorted((r["question"], r["model_answer"]) for r in got) == [("other", "z"), ("same", "a0")]
