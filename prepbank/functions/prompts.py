"""Prompt texts as columns. The model call stays outside: prompts leave as a table."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions.template import fill
from prepbank.functions.text import key_points, md_bullets, one_decimal, tier_text


def strategy(profile_name: Column, experience: Column, role: Column, resume: Column) -> Column:
    return fill(fixed.STRATEGY_PROMPT, profile_name=profile_name, experience=experience, role=role, resume=resume)


def question(
    profile_name: Column,
    experience: Column,
    role: Column,
    question_type: Column,
    resume: Column,
    reference_questions: Column,
    recent_avg: Column,
) -> Column:
    return fill(
        fixed.QUESTION_PROMPT,
        profile_name=profile_name,
        experience=experience,
        role=role,
        question_type=F.coalesce(question_type, F.lit(fixed.DEFAULT_TYPE)),
        resume=resume,
        reference_questions=reference_questions,
        tier=tier_text(recent_avg),
    )


def frame(question: Column, points: Column, experience: Column, role: Column) -> Column:
    return fill(
        fixed.FRAME_PROMPT, question=question, points=md_bullets(key_points(points)), experience=experience, role=role
    )


def evaluation(question: Column, model_answer: Column, user_answer: Column) -> Column:
    return fill(fixed.EVALUATION_PROMPT, question=question, model_answer=model_answer, user_answer=user_answer)


def report_frame(profile_name: Column, role: Column, avg_score: Column) -> tuple[Column, Column]:
    """What stands ahead of the history in a report prompt, and what stands behind it."""
    values = {"profile_name": profile_name, "role": role, "average": one_decimal(avg_score)}
    head, tail = (fill(piece, **values) for piece in fixed.REPORT_PROMPT.split("{history}"))
    return head, tail


def report(profile_name: Column, role: Column, avg_score: Column, history: Column) -> Column:
    head, tail = report_frame(profile_name, role, avg_score)
    return F.concat(head, F.coalesce(history, F.lit("")), tail)
