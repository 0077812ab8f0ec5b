"""JSON payloads inside noisy generated text: recover, type, score, render.

A response column is the generated text, null or '' when the model gave none.
"""

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions.jsons import is_object, kind, let, list_field, parse_json, text_field
from prepbank.functions.text import md_bullets, resume_gate, strip, strip_fences

PARSED, PARSE_ERROR, NO_RESPONSE, MOCK = "parsed", "parse_error", "no_response", "mock"


def json_text(c: Column) -> Column:
    """First ``{`` to the last ``}`` over all lines, else the text without fence tokens."""
    start = F.instr(c, "{")
    end = F.length(c) - F.length(F.substring_index(c, "}", -1))
    return F.when((start > 0) & (end > start), F.substr(c, start, end - start + 1)).otherwise(strip_fences(c))


def recover_json(c: Column) -> Column:
    """Variant parsed from ``json_text``; null when that is no JSON."""
    return parse_json(json_text(c))


def recover_json_fenced(c: Column) -> Column:
    """Variant parsed after removing fence tokens only, with no search for braces."""
    return parse_json(strip_fences(c))


def generated_question(raw: Column) -> Column:
    """Question and model answer of a generated text; null where it does not parse."""
    return let(
        recover_json_fenced(raw),
        lambda v: F.struct(
            text_field(v, "question").alias("question"), text_field(v, "model_answer").alias("model_answer")
        ),
    )


# ---- evaluation ------------------------------------------------------------------------------


def eval_score(v: Column) -> Column:
    """Score as a double: 5.0 when the key is absent, null when it is there but no number. Not clamped."""
    number = F.try_variant_get(v, "$.score", "double")
    return F.when(is_object(v), F.when(kind(v, "$.score").isNull(), fixed.DEFAULT_SCORE).otherwise(number))


def evaluate(raw: Column, has_key: Column | None = None) -> Column:
    """Struct of ``outcome`` and the ``score`` that reaches the log.

    The outcome is parsed, parse_error, no_response, or mock without credentials; only parsed and mock ones score.
    """
    has_key = F.lit(True) if has_key is None else has_key
    missing = raw.isNull() | (raw == "")
    parsed = F.when(has_key & ~missing, let(recover_json(raw), eval_score))

    def result(score):
        outcome = F.when(~has_key, MOCK).when(missing, NO_RESPONSE).when(score.isNull(), PARSE_ERROR).otherwise(PARSED)
        logged = F.when(~has_key, fixed.MOCK_SCORE).otherwise(score)
        return F.struct(outcome.alias("outcome"), logged.alias("score"))

    return let(parsed, result)


def eval_outcome(raw: Column, has_key: Column | None = None) -> Column:
    return evaluate(raw, has_key)["outcome"]


def logged_score(raw: Column, has_key: Column | None = None) -> Column:
    return evaluate(raw, has_key)["score"]


def feedback(raw: Column, outcome: Column) -> Column:
    """JSON of the evaluation to show: the recovered one, the fixed one without credentials, null after an error."""
    return F.when(outcome == PARSED, json_text(raw)).when(outcome == MOCK, fixed.MOCK_EVALUATION)


def evaluation(v: Column) -> Column:
    """Typed evaluation fields; absent or unusable ones are empty."""

    def items(name):
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))

    return F.struct(
        eval_score(v).alias("score"),
        F.coalesce(text_field(v, "summary"), F.lit("")).alias("summary"),
        items("strengths").alias("strengths"),
        items("weaknesses").alias("weaknesses"),
        items("improvement_tips").alias("improvement_tips"),
        F.coalesce(text_field(v, "improved_answer"), F.lit("")).alias("improved_answer"),
    )


# ---- rendered texts -----------------------------------------------------------------------------


def _rendered(raw: Column, names: list[str], show: Callable[[list[Column]], Column], bad: Column) -> Column:
    """``show`` of the list fields of the recovered object, ``bad`` when any is no list."""

    def fields(v):
        lists = [F.when(is_object(v), list_field(v, name)).alias(name) for name in names]
        return F.struct(*lists)

    def text(found):
        lists = [found[name] for name in names]
        usable = reduce(and_, (x.isNotNull() for x in lists))
        return F.when(usable, strip(show(lists))).otherwise(bad)

    return let(let(recover_json(raw), fields), text)


def report_text(raw: Column) -> Column:
    """Weak areas and study plan as text; the raw response when it does not parse."""

    def block(heading, items, marker):
        lines = F.when(F.size(items) > 0, F.concat(md_bullets(items, marker), F.lit("\n"))).otherwise("")
        return F.concat(F.lit(heading + "\n"), lines)

    def show(lists):
        weak, plan = lists
        return F.concat(
            block(fixed.WEAK_AREAS_HEADING, weak, "*"), F.lit("\n"), block(fixed.STUDY_PLAN_HEADING, plan, "-")
        )

    missing = raw.isNull() | (raw == "")
    return F.when(missing, fixed.REPORT_NO_RESPONSE).otherwise(
        _rendered(raw, ["weak_areas", "study_plan"], show, raw)
    )


def strategy_text(
    resume: Column, raw: Column, has_key: Column | None = None, no_key: str = fixed.STRATEGY_NO_KEY
) -> Column:
    """Strategy bullets, or the message for a missing key, short background, bad parse or missing response."""
    has_key = F.lit(True) if has_key is None else has_key
    shown = _rendered(
        raw, ["strategy_bullets"], lambda lists: md_bullets(lists[0], "*"), F.lit(fixed.STRATEGY_BAD_PARSE)
    )
    return (
        F.when(~has_key, no_key)
        .when(resume_gate(resume).isNotNull(), resume_gate(resume))
        .when(raw.isNull() | (raw == ""), fixed.STRATEGY_NO_RESPONSE)
        .otherwise(shown)
    )
