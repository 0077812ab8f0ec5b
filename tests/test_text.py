"""Text expressions on literal rows; expected values are written by hand or come from Python's own functions."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import text


def values(spark, fn, inputs, schema="s string"):
    """fn over a column of inputs, in order."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {schema}")
    return [r["o"] for r in rows.select("i", fn(F.col(schema.split()[0])).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, given, wanted",
    [
        (text.clean_question, "3. _what_ is *x*?", "what is x?"),
        (text.clean_question, "12. Why _a\nb_ ?\n", "Why _a\nb_ ?"),
        (text.clean_question, "1.2 is ** a number", "2 is  a number"),
        (text.classify_role, "How is storage tuned?", "AI Engineer"),
        (text.classify_role, "Clean a report with LLM", "Data Analyst"),
        (text.classify_role, "Neural nets", "Machine Learning Engineer"),
        (text.classify_role, "What is CLT?", "Data Scientist"),
        (text.difficulty_label, "Explain CLT", "medium"),
        (text.difficulty_label, "What is CLT?", "hard"),
        (text.strip_prefix, "answer: Answer: yes", "yes"),
        (text.strip_prefix, "Answer:answer:answer: x", "answer: x"),
        (text.strip_prefix, " answer: x", " answer: x"),
        (text.strip_trailing_fence, "a\n```\nb\n```", "a"),
        (text.strip_trailing_fence, "a ```b", "a ```b"),
        (text.strip_fences, " ```json\n{}\n``` ", "{}"),
        (text.strip_tail, "a\ndef f():\n  x", "a"),
        (text.strip_tail, "a\nclass f\nNOTE: x", "a\nclass f"),
        (text.strip_tail, "a\nclass F\n```", "a"),
        (text.strip_tail, "a\n**note** x", "a"),
        (text.bullets, "- a\n* b\n\ndef f\nrun()", ["a", "b"]),
        (text.bullets, "  - a\n-b\n`c\n#d\nprint(1)\nno_code x\nrun() now", ["- a", "b", "run() now"]),
        (text.escape_html, "<a> & &lt;", "&lt;a&gt; &amp; &amp;lt;"),
        (text.score_text, " 7/10 /10 ", "7 /10"),
        (text.clean_improved, "x ```a\nb``` y END \n", "x  y"),
        (text.clean_improved, "the WEEKEND", "the WEEKEND"),
        (text.nl2br, "a\nb", "a<br>b"),
        (text.answer_or_default, "", fixed.NO_ANSWER),
        (text.answer_or_default, None, fixed.NO_ANSWER),
        (text.resume_gate, "  fourteen chars  ", fixed.SHORT_BACKGROUND),
        (text.resume_gate, "fifteen  chars.", None),
        (text.is_question, "is this 15 ch??", False),
        (text.is_question, "is this 16 chs??", True),
        (text.is_project_question, "What have you BUILT?", True),
        (text.is_project_question, "worked  on", False),
        (text.file_kind, "a/CV.PDF", "pdf"),
        (text.file_kind, "cv.docx", "docx"),
        (text.file_kind, "cv.pdf.txt", "unsupported"),
        (text.template_answer, "Q?", fixed.EXTRACTED_ANSWER.replace("{question}", "Q?")),
    ],
)
def test_one_text(spark, fn, given, wanted):
    assert values(spark, fn, [given]) == [wanted]


def test_sections(spark):
    s = "SCORE: 7/10\nSUMMARY: ok\nfine"
    assert values(spark, lambda c: text.section("SUMMARY", c), [s, "x", "Summary:  \n", "summary a\nWEAK:"]) == [
        "ok\nfine",
        None,
        None,
        "a",
    ]
    # the blank after a label may be the line break before the next one, which then is part of the section
    assert values(spark, lambda c: text.section("SCORE", c), ["SCORE:\nSUMMARY: x\nB: y"]) == ["SUMMARY: x"]
    got = values(spark, text.feedback_sections, [s + "\nSTRENGTHS:\n- <a>\n- b\nIMPROVED_ANSWER: do END", "no <labels>\nat all"])
    assert (got[0]["score"], got[0]["summary"], got[0]["strengths"]) == ("7", "ok\nfine", ["&lt;a&gt;", "b"])
    assert (got[0]["improved_answer"], got[0]["plain"]) == ("do", None)
    assert got[1]["plain"] == "<p>no &lt;labels&gt;<br>at all</p>"


def test_strip_removes_what_python_strips(spark):
    every = "".join(chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000)
    spaces = [c for c in every if c.isspace()]
    assert sorted(spaces) == sorted(fixed.WHITESPACE)
    rng = random.Random(1)
    inputs = []
    for _ in range(300):
        ends = ["".join(rng.choices(spaces, k=rng.randrange(4))) for _ in range(2)]
        inputs.append(ends[0] + rng.choice(["a b", "", "x y", "﻿z"]) + ends[1])
    assert values(spark, text.strip, inputs) == [s.strip() for s in inputs]


def test_clean_question_strips_every_digit_kind(spark):
    digits = [chr(i) for i in range(0x10000) if unicodedata.category(chr(i)) == "Nd"][::7]
    assert values(spark, text.clean_question, [d + ". x" for d in digits]) == ["x"] * len(digits)


def test_one_decimal_rounds_the_exact_value(spark):
    rng = random.Random(2)
    xs = [0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 9.95, 9.949999999999999, 10.0, 1e-9, 123456.25, -0.25, -7.35, 4.45]
    xs += [rng.randrange(2000) / 20 for _ in range(300)] + [rng.random() * 10 for _ in range(300)]
    xs += [sum(rng.choices(range(11), k=n)) / n for n in range(1, 100)]
    assert values(spark, text.one_decimal, xs, "x double") == [f"{x:.1f}" for x in xs]


def test_score_repr(spark):
    xs = [7.0, 8.25, 0.1, 0.0, 1e-4, 1e-5, 1.5e-7, 12345678.9, 1e7, 1e16, 1.25e20, -3.0]
    assert values(spark, text.score_repr, xs, "x double") == [repr(x) for x in xs]


def test_tier_bounds(spark):
    got = values(spark, text.difficulty_tier, [4.99, 5.0, 7.99, 8.0], "x double")
    assert got == ["easier", "none", "none", "harder"]


def test_extract_strings(spark):
    page = '<p><script type="application/json" id="x">{}</script>'
    got = values(
        spark,
        text.extract_strings,
        [
            page.format('["a?", 1, null, ["z"], {"q": 1}, "b"]'),
            page.format('{"a": 1}'),
            page.format('["a"] x'),
            page.format('["x",\n"y"]') + page.format('["second"]'),
            "none",
        ],
    )
    assert got == [["a?", "b"], None, None, ["second"], None]


def test_lists(spark):
    assert values(spark, text.key_points, [[" a ", "", "\n", "b"]], "p array<string>") == [["a", "b"]]
    assert values(spark, lambda c: text.md_bullets(c, "*"), [["a", "b"], []], "p array<string>") == ["* a\n* b", ""]


def test_framed_answer(spark):
    rows = spark.createDataFrame([("Answer: yes\n```\nx", "- p"), ("", "- p"), (None, "- p")], "r string, f string")
    got = rows.select(text.framed_answer(F.col("r"), F.col("f")).alias("o")).collect()
    assert [r["o"] for r in got] == ["yes", "- p", "- p"]


def test_local_time(spark):
    stamps = spark.sql("SELECT timestamp '2024-01-01 00:05:07' AS t UNION ALL SELECT timestamp '2024-11-20 13:00:00'")
    got = [r[0] for r in stamps.select(text.local_time(F.col("t"))).collect()]
    assert sorted(got) == ["1/1/2024, 12:05:07 AM", "11/20/2024, 1:00:00 PM"]


def section_by_hand(label, text):
    found = re.search(f"(?is){label}:?(.*)", text, re.ASCII)
    if found is None:
        return None
    rest = re.split(r"(?ai)\n[A-Z_]+:", found[1].lstrip(fixed.PAGE_WHITESPACE), maxsplit=1)[0].strip(fixed.PAGE_WHITESPACE)
    return re.split(r"\n(?:```|def [a-z]|class [A-Z]|(?i:Note:|\*\*Note))", rest, maxsplit=1)[0] or None


def test_sections_of_odd_texts_by_hand(spark):
    """Labels anywhere, repeated, in any case, inside other words, behind white space and headers; very many of them in one text."""
    rng = random.Random(5)
    bits = [*fixed.SECTION_LABELS, *[x.lower() for x in fixed.SECTION_LABELS], "\n", "\n", ":", ":", " ", "\t", "x", "ß", "ſcore", "OTHER", "a_b", "\nNote: y", "\n```", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    texts += ["", "score", "SCORE:", "SCORE:\n\n \nA:\nB: x", "ſcore: x\nSCORE: y", "summary " * 20_000 + "\nEND: x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(4)
    for r in rows.select("s", text.sections(F.col("s")).alias("x"), text.section("SUMMARY", F.col("s")).alias("one")).collect():
        wanted = {label: section_by_hand(label, r["s"]) for label in fixed.SECTION_LABELS}
        assert r["x"].asDict() == wanted and r["one"] == wanted["SUMMARY"], r["s"][:200]
