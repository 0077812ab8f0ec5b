"""Question-bank construction: extract, classify, pad, merge under a quota, behavioural rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import text
from prepbank.functions.template import fill
from prepbank.operators.ordering import first_rows

# ---- extraction -----------------------------------------------------------------------------


# Groups of a role that are cut down to its quota apart.
QUOTA_SALTS = 64

def page_questions(pages: DataFrame) -> DataFrame:
    """Cleaned question texts of every page, one row each. A page that does not parse gives none."""
    found = pages.select(F.explode(text.extract_strings(F.col("html"))).alias("raw"))
    return found.where(text.is_question(F.col("raw"))).select(text.clean_question(F.col("raw")).alias("question"))


def distinct_questions(df: DataFrame) -> DataFrame:
    return df.select("question").distinct()


def extract_questions(pages: DataFrame) -> DataFrame:
    """Pages to clean distinct questions."""
    return distinct_questions(page_questions(pages))


# ---- unions ------------------------------------------------------------------------------------


def union_roles(*parts: DataFrame) -> DataFrame:
    """One bank of several role sets; the same question may stand under several roles."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extend_bank(bank: DataFrame, soft: DataFrame) -> DataFrame:
    """Bank and behavioural rows together; keys that one side lacks are null there."""
    return bank.unionByName(soft, allowMissingColumns=True)


def _literal_table(spark: SparkSession, rows: list[dict[str, str]]) -> DataFrame:
    """A few constant rows."""
    items = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items)))


# ---- role banks ----------------------------------------------------------------------------------


def pad_to_quota(
    curated: DataFrame, n: int = fixed.ROLE_QUOTA, templates: dict[str, tuple[str, str]] | None = None
) -> DataFrame:
    """Curated rows ``role, pos, question, model_answer`` plus numbered template rows up to n per templated role.

    Roles with a template but no rows are padded from 1.
    """
    templates = fixed.PADDING if templates is None else templates
    wording = _literal_table(
        curated.sparkSession, [{"role": role, "_q": q, "_a": a} for role, (q, a) in templates.items()]
    )
    # the template table is a constant of a few rows, so its side is broadcast
    counts = curated.join(F.broadcast(wording.select("role")), "role", "left_semi").groupBy("role").count()
    short = wording.join(counts, "role", "left").withColumn("_have", F.coalesce("count", F.lit(0)))
    missing = short.where(F.col("_have") < n).withColumn("pos", F.explode(F.sequence(F.col("_have"), F.lit(n - 1))))
    number = (F.col("pos") + 1).cast("string")
    padding = missing.select(
        "role",
        "pos",
        F.replace("_q", F.lit("{n}"), number).alias("question"),
        F.replace("_a", F.lit("{n}"), number).alias("model_answer"),
    )
    return curated.select("role", "pos", "question", "model_answer").unionByName(padding)


def extracted_rows(questions: DataFrame) -> DataFrame:
    """Extracted questions under the role their words name, ahead of all others (priority 0)."""
    return questions.select(
        text.classify_role(F.col("question")).alias("role"),
        F.lit(0).alias("priority"),
        F.lit(0).cast("bigint").alias("pos"),
        "question",
        F.lit(None).cast("string").alias("model_answer"),
    )


def curated_rows(curated: DataFrame) -> DataFrame:
    """Curated ``role, pos, question, model_answer`` rows, after the extracted ones (priority 1)."""
    return curated.select(
        "role", F.lit(1).alias("priority"), F.col("pos").cast("bigint").alias("pos"), "question", "model_answer"
    )


def first_occurrences(rows: DataFrame) -> DataFrame:
    """The first row of every question inside a role. Copies are reduced in each task ahead of the shuffle."""
    order = [F.asc("priority"), F.asc("pos"), F.asc("model_answer")]
    return first_rows(rows, ["role", "question"], order, 1, "_first").drop("_first")


def role_quota(rows: DataFrame, n: int = fixed.ROLE_QUOTA) -> DataFrame:
    """The first n rows of every role, in two steps: roles are few, so their rows are first cut down over QUOTA_SALTS groups each."""
    order = [F.asc("priority"), F.asc("pos"), F.asc("question")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("question"), F.lit(QUOTA_SALTS)))
    few = first_rows(salted, ["role", "_salt"], order, n, "_near").drop("_salt", "_near")
    return first_rows(few, ["role"], order, n, "place")


def bank_rows(placed: DataFrame) -> DataFrame:
    """Full bank rows of placed rows; the long derived texts are made only for the rows that stay."""
    role, question, extracted = F.col("role"), F.col("question"), F.col("priority") == 0
    return placed.select(
        "role",
        text.category(extracted).alias("category"),
        "question",
        text.answer_strategy(role, extracted).alias("answer_strategy"),
        text.tags(role, extracted).alias("tags"),
        F.when(extracted, "medium").otherwise(text.difficulty_label(question)).alias("difficulty"),
        F.when(extracted, text.template_answer(question)).otherwise(F.col("model_answer")).alias("model_answer"),
        "place",
    )


def build_bank(extracted: DataFrame, curated: DataFrame, n: int = fixed.ROLE_QUOTA) -> DataFrame:
    """Per role the extracted questions (in text order) ahead of the curated ones, each once, n at most."""
    return bank_rows(role_quota(first_occurrences(extracted_rows(extracted).unionByName(curated_rows(curated))), n))


def bank_counts(bank: DataFrame) -> DataFrame:
    """Rows per role, and of the whole bank on the row without a role (``is_total``)."""
    per_role = bank.groupBy("role").agg(F.count(F.lit(1)).alias("n"))
    return per_role.rollup("role").agg(F.grouping("role").cast("int").alias("is_total"), F.sum("n").alias("n"))


# ---- behavioural rows --------------------------------------------------------------------------------


def template_grid(
    themes: DataFrame, roles: Sequence[str] = fixed.ROLES, levels: Sequence[str] = fixed.LEVELS
) -> DataFrame:
    """Every theme row with every role and level. Roles and levels are short lists, so no join is needed."""
    with_role = themes.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    return with_role.withColumn("experience", F.explode(F.array(*[F.lit(x) for x in levels])))


def theme_table(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, [{"theme": t, "base_question": q} for t, q in fixed.THEMES])


def _draw(seed: int, part: str, key: Column, size: int) -> Column:
    """Seeded index from 1 to size."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(part), key.cast("string")))
    number = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return (number % size + 1).cast("int")


def soft_skill_rows(draws: DataFrame, key: str = "id", seed: int = 0) -> DataFrame:
    """One behavioural row per row of ``draws``: theme, role and level drawn with replacement by a seeded hash.

    ``spark.range(fixed.BEHAVIORAL_ROWS)`` as draws gives the standard set.
    """

    def pick(part, options, *fields):
        values = F.array(*options)
        return F.element_at(values, _draw(seed, part, F.col(key), len(options)))

    theme = pick("theme", [F.struct(F.lit(t).alias("theme"), F.lit(q).alias("base_question")) for t, q in fixed.THEMES])
    drawn = draws.select(
        key,
        theme.alias("_theme"),
        pick("role", [F.lit(r) for r in fixed.ROLES]).alias("role"),
        pick("level", [F.lit(x) for x in fixed.LEVELS]).alias("experience"),
    )
    question = fill(
        fixed.BEHAVIORAL_QUESTION,
        theme=F.col("_theme.theme"),
        experience=F.col("experience"),
        role=F.col("role"),
        base_question=F.col("_theme.base_question"),
    )
    answer = fill(fixed.BEHAVIORAL_ANSWER, experience=F.col("experience"), role=F.col("role"))
    return drawn.select(
        key,
        "role",
        F.lit(fixed.BEHAVIORAL_TYPE).alias("type"),
        "experience",
        question.alias("question"),
        answer.alias("model_answer"),
        F.lit(fixed.BEHAVIORAL_STRATEGY).alias("answer_strategy"),
    )


# ---- index rows ------------------------------------------------------------------------------------------


def index_rows(bank: DataFrame) -> DataFrame:
    """Columns of the retrieval index: document text, metadata, id. Missing keys get their defaults."""
    filled = bank.select(
        "id",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("model_answer", F.lit("")).alias("model_answer"),
        F.coalesce("type", F.lit(fixed.DEFAULT_TYPE)).alias("type"),
    )
    document = text.doc_text(F.col("role"), F.col("type"), F.col("question"))
    return filled.select("id", document.alias("document"), "role", "question", "model_answer", "type")


def require_nonblank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose named columns all hold more than whitespace."""
    for c in columns:
        df = df.where(F.length(text.page_trim(F.col(c))) > 0)
    return df
