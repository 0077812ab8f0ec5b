"""The three main flows, each as one job between tables: prompts go out, responses come in."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.functions import payload, prompts, text
from prepbank.operators import bank as banks
from prepbank.operators import history as scores
from prepbank.operators import retrieve
from prepbank.operators.ordering import MAX_GROUP_ROWS, lookup
from prepbank.session import materialize
from prepbank.sources import bank_files, score_log


def bank_from_pages(
    pages: DataFrame, curated: DataFrame, soft: DataFrame | None = None, templates=None, n: int = fixed.ROLE_QUOTA
) -> DataFrame:
    """Pages and curated rows to the whole bank, with the behavioural rows added."""
    padded = banks.pad_to_quota(curated, n, templates)
    built = banks.build_bank(banks.extract_questions(pages), padded, n)
    return built if soft is None else banks.extend_bank(built, soft)


def nearest_questions(
    requests: DataFrame,
    index: DataFrame,
    k: int = fixed.RETRIEVED,
    request_id: str = "session_id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Ids, distances and ranks of the nearest bank questions of every request. Both sides carry ``embedding``.

    ``request_id`` names the unique id of a request: another column where a session asks more than once.
    """
    return materialize(retrieve.knn(requests, index, k, request_id, max_group_rows=max_group_rows), "nearest")


def retrieved_questions(
    requests: DataFrame,
    index: DataFrame,
    k: int = fixed.RETRIEVED,
    request_id: str = "session_id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``nearest_questions`` with question and answer text."""
    near = nearest_questions(requests, index, k, request_id, max_group_rows)
    return retrieve.with_bank_rows(near, index, max_group_rows=max_group_rows)


def _search_path(path: str) -> str:
    return f"{path.rstrip('/')}.search"


def load_embedded_index(bank: DataFrame, path: str, fn=None, **tree) -> bool:
    """Write the retrieval index of a bank once, by role, each row with the vector of its document text, and beside it the search tree of
    its vectors. ``tree`` goes to ``load_vectors``."""
    if not bank_files.load_index(retrieve.embed(banks.index_rows(bank), "document", fn), path):
        return False
    retrieve.load_vectors(bank_files.read_index(bank.sparkSession, path), _search_path(path), **tree)
    return True


def nearest_by_text(
    requests: DataFrame,
    path: str,
    fn=None,
    k: int = fixed.RETRIEVED,
    request_id: str = "session_id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Nearest questions of a loaded index for the query texts of requests. ``fn`` is the index's embedding.

    Only the parts of the search tree that requests open are read; texts come with ``retrieve.with_bank_rows``.
    """
    kind = F.coalesce("question_type", F.lit(fixed.DEFAULT_TYPE))
    asked = requests.withColumn("_query", text.query_text(F.col("role"), F.col("resume"), kind))
    asked = retrieve.embed(asked, "_query", fn).drop("_query")
    near = retrieve.nearest(asked, _search_path(path), k, request_id, max_group_rows=max_group_rows)
    return materialize(near, "nearest")


def question_prompts(
    requests: DataFrame,
    retrieved: DataFrame,
    history: DataFrame,
    seed: int = 0,
    request_id: str = "session_id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    bank: DataFrame | None = None,
) -> DataFrame:
    """Prompt for the next question of every request that has retrieved questions. With a ``bank``, ``retrieved`` are ids alone, and the
    texts of the few that are shown come from it."""
    asked = scores.with_recent_avg(requests, history, max_group_rows=max_group_rows)
    asked = retrieve.reference_block(retrieved, key=request_id, seed=seed, bank=bank, max_group_rows=max_group_rows, onto=asked)
    columns = ["profile_name", "experience", "role", "question_type", "resume", "reference_questions", "recent_avg"]
    prompt = prompts.question(**{c: F.col(c) for c in columns})
    return asked.select(request_id, "recent_avg", prompt.alias("prompt"))


def generated_or_static(
    retrieved: DataFrame,
    generated: DataFrame,
    seed: int = 0,
    request_id: str = "session_id",
    generated_label: str = "generated",
    static_label: str = "static-rag",
    bank: DataFrame | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """The generated question where the response ``<request_id>, raw`` holds both texts, else the first shuffled one. With a ``bank``,
    ``retrieved`` are ids alone, and the texts of those that are shown come from it."""
    found = payload.generated_question(F.col("raw")).alias("_g")
    texts = generated.select(request_id, found).select(
        request_id, F.col("_g.question").alias("_q"), F.col("_g.model_answer").alias("_a")
    )
    usable = F.coalesce((F.col("_q") != "") & (F.col("_a") != ""), F.lit(False))
    picked = retrieve.pick_one(retrieved if bank is None else retrieved.select(request_id, "id"), request_id, seed=seed)
    joined = picked.join(texts, request_id, "left")
    if bank is not None:
        joined = materialize(joined.withColumn("_usable", usable), "picked")
        static = retrieve.with_bank_rows(joined.where(~F.col("_usable")), bank, max_group_rows=max_group_rows)
        joined = static.unionByName(joined.where("_usable"), allowMissingColumns=True)
    return joined.select(
        request_id,
        F.when(usable, F.col("_q")).otherwise(F.col("question")).alias("question"),
        F.when(usable, F.col("_a")).otherwise(F.col("model_answer")).alias("model_answer"),
        F.when(usable, generated_label).otherwise(static_label).alias("source"),
    )


def evaluated_scores(responses: DataFrame, has_key: bool = True) -> DataFrame:
    """Scores that reach the log, from responses ``session_id, question, raw`` (and ``timestamp``).

    Rows without a score go in the explode, so every response is parsed once, not in a filter and again after it.
    """
    keep = [c for c in ("session_id", "question", "timestamp") if c in responses.columns]
    score = payload.logged_score(F.col("raw"), F.lit(has_key))
    return responses.select(*keep, F.explode(F.array_compact(F.array(score))).alias("score"))


def evaluate_and_log(
    responses: DataFrame, table: str, has_key: Column | bool = True, order=None, batch: str | None = None
) -> DataFrame:
    """Evaluate the responses ``session_id, question, raw`` (and ``timestamp``), append the scores to the history table,
    and return the responses with ``outcome``, ``score`` and ``feedback``. Each response is parsed once.

    ``order`` names the columns by which ids are given out, ``batch`` the append, so that a job that is run again logs nothing twice.
    """
    has_key = F.lit(has_key) if isinstance(has_key, bool) else has_key
    result = payload.evaluate(F.col("raw"), has_key).alias("_e")
    evaluated = responses.select("*", result).select("*", "_e.*").drop("_e")
    evaluated = evaluated.withColumn("feedback", payload.feedback(F.col("raw"), F.col("outcome"))).drop("raw")
    evaluated = materialize(evaluated, "evaluated")
    keep = [c for c in ("session_id", "question", "score", "timestamp") if c in evaluated.columns]
    scored = evaluated.where(F.col("score").isNotNull()).select(*keep)
    score_log.log_scores(scored, table, order or ("session_id", "question", "score"), batch=batch)
    return evaluated


def session_page(history: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Rows of the history page, one per question: session number, average, date, question number, question and score.

    Sort by (session_no, question_no). Without any history there is one row, the ``message`` for that. Sessions and their averages are
    those at the time of the call.
    """
    # The history is grouped once; stamps, numbers and hot sessions come from the one row per session.
    sessions = scores.session_summary(history, timestamp=F.max("timestamp"), _rows=F.count(F.lit(1)))
    sessions = materialize(sessions.select("session_id", "avg_display", "timestamp", "_rows"), "sessions")
    sizes = sessions.select("session_id", "_rows")
    stamps = scores.number_sessions(scores.session_list(sessions), max_group_rows)
    heads = stamps.join(sessions.select("session_id", "avg_display"), "session_id").select(
        "session_id", "session_no", "avg_display", text.local_time(F.col("timestamp")).alias("date")
    )
    items = scores.history_items(history, max_group_rows, sizes).select("session_id", "question_no", "question", "score")
    rows = lookup(items, heads, ["session_id"], "inner", max_group_rows, sizes)
    rows = rows.withColumn("message", F.lit(None).cast("string"))
    nothing = history.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return rows.unionByName(nothing.select(F.lit(fixed.PAGE_NO_HISTORY).alias("message")), allowMissingColumns=True)


def reports(
    requests: DataFrame, history: DataFrame, responses: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """Report text and average of every request, from the responses ``session_id, raw`` to the report prompts."""
    joined = scores.report_or_empty(requests, history, max_group_rows)
    joined = lookup(joined, responses.select("session_id", "raw"), ["session_id"], "left", max_group_rows)
    report = F.coalesce("report", payload.report_text(F.col("raw")))
    return joined.select("session_id", report.alias("report"), F.col("avg_score").alias("average_score"))


def strategies(requests: DataFrame, responses: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Strategy text of every request, from the responses ``session_id, raw`` to the strategy prompts."""
    joined = lookup(requests, responses.select("session_id", "raw"), ["session_id"], "left", max_group_rows)
    return joined.select("session_id", payload.strategy_text(F.col("resume"), F.col("raw")).alias("strategy"))


def framed_answers(answers: DataFrame, responses: DataFrame, max_group_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Answers ``session_id, key_points`` (and more) framed by their responses; the point lines where there is no response."""
    joined = lookup(answers, responses.select("session_id", "raw"), ["session_id"], "left", max_group_rows)
    points = text.md_bullets(text.key_points(F.col("key_points")))
    keep = [c for c in answers.columns if c != "key_points"]
    return joined.select(*keep, text.framed_answer(F.col("raw"), points).alias("framed_answer"))
