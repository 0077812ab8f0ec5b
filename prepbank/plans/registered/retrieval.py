"""Vectors, nearest questions, shuffles, next-question prompts."""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.operators import retrieve as r
from prepbank.plans import flows, views
from prepbank.plans.registered.base import (
    BANK,
    HISTORY,
    RECENT,
    REQUESTS,
    RETRIEVED,
    query,
    quoted,
    sql_fill,
    with_views,
)
from prepbank.session import fresh_path

_NEAR = """near AS (
  SELECT request, id, distance, row_number() OVER (PARTITION BY request ORDER BY distance, id)::INTEGER AS rank FROM (
    SELECT q.vec_id AS request, b.vec_id AS id, {distance} AS distance
    FROM embeddings q JOIN embeddings b ON q.label = b.label))
SELECT request, id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 20"""

_SQUARED = "list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q.embedding::DOUBLE[], b.embedding::DOUBLE[])])"


def _self_knn(spark, folder, **options):
    bank = views.vector_bank(spark, folder)
    asked = bank.select(F.col("id").alias("request"), "role", "embedding")
    near = r.knn(asked, bank, fixed.RETRIEVED, request_id="request", **options)
    return near.select("request", "id", F.round("distance", 6).alias("distance"), "rank")


@query("c1_knn", "WITH " + _NEAR.format(distance=_SQUARED))
def knn(spark, folder):
    return _self_knn(spark, folder)


@query(
    "c1_knn_cosine",
    "WITH " + _NEAR.format(distance="1 - list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[])"),
)
def knn_cosine(spark, folder):
    return _self_knn(spark, folder, metric="cosine")


@query("c1_knn_cells", "WITH " + _NEAR.format(distance=_SQUARED))
def knn_cells(spark, folder):
    """The plan of large banks: vectors in cells, pruned by the triangle inequality."""
    return _self_knn(spark, folder, cell_rows=64)


@query(
    "c1_knn_repeated",
    f"""WITH asked AS (SELECT vec_id * 3 + n AS request, vec_id % 7 AS vec, (label + n) % 10 AS role
    FROM embeddings, (VALUES (0), (1), (2)) AS t(n)),
  near AS (SELECT request, id, distance, row_number() OVER (PARTITION BY request ORDER BY distance, id)::INTEGER AS rank FROM (
    SELECT a.request, b.vec_id AS id, {_SQUARED} AS distance
    FROM asked a JOIN embeddings q ON a.vec = q.vec_id JOIN embeddings b ON a.role = b.label))
SELECT request, id, round(distance, 6) AS distance, rank FROM near WHERE rank <= 20""",
)
def knn_repeated(spark, folder):
    """Requests that repeat seven vectors within roles and across them."""
    bank = views.vector_bank(spark, folder)
    few = bank.where("id < 7").select(F.col("id").alias("vec"), "embedding")
    asked = bank.select("id", "role", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n")).select(
        (F.col("id") * 3 + F.col("n")).alias("request"), (F.col("id") % 7).alias("vec"), ((F.col("role") + F.col("n")) % 10).alias("role")
    )
    near = r.knn(asked.join(F.broadcast(few), "vec"), bank, fixed.RETRIEVED, request_id="request")
    return near.select("request", "id", F.round("distance", 6).alias("distance"), "rank")


@query(
    "c3_unmatched",
    with_views(BANK, REQUESTS) + f"SELECT session_id, role, {quoted(fixed.NO_QUESTIONS)} AS message FROM requests WHERE role NOT IN (SELECT role FROM bank)",
)
def unmatched(spark, folder):
    return r.unmatched(views.requests(spark, folder), views.bank(spark, folder)).select("session_id", "role", "message")


@query(
    "u1_embed",
    f"""SELECT doc_id, {r.EMBEDDING_DIMS} AS dims,
  CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""",
)
def embed(spark, folder):
    out = r.embed(views.table(spark, folder, "documents").select("doc_id", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(norm, 5).alias("norm"))


@query(
    "f5_clamp_k",
    "SELECT c_custkey, least(c_custkey % 30, greatest(1, (SELECT count(*) FROM benchmark))) AS k, "
    "least(20, greatest(1, c_nationkey)) AS by_total FROM customer",
)
def clamp_k(spark, folder):
    total = views.table(spark, folder, "benchmark").count()
    return views.table(spark, folder, "customer").select(
        "c_custkey", r.clamp_k(F.col("c_custkey") % 30, total).alias("k"),
        r.clamp_k(fixed.RETRIEVED, F.col("c_nationkey")).alias("by_total"),
    )


@query(
    "f3_shuffle_rows",
    """SELECT user_id, event_id,
  row_number() OVER (PARTITION BY user_id ORDER BY md5('5|' || user_id || '|' || event_id), event_id) AS place FROM events""",
)
def shuffle_rows(spark, folder):
    rows = views.table(spark, folder, "events").select("user_id", "event_id")
    return r.shuffle_rows(rows, "user_id", "event_id", seed=5)


@query(
    "f4_pick_one",
    """SELECT user_id, event_id, event_type FROM (SELECT *,
  row_number() OVER (PARTITION BY user_id ORDER BY md5('5|' || user_id || '|' || event_id), event_id) AS place FROM events)
WHERE place = 1""",
)
def pick_one(spark, folder):
    rows = views.table(spark, folder, "events").select("user_id", "event_id", "event_type")
    return r.pick_one(rows, "user_id", "event_id", seed=5)


# ---- the flow from request to prompt --------------------------------------------------------------


def _retrieved(spark, folder):
    return flows.retrieved_questions(views.request_vectors(spark, folder), views.document_vectors(spark, folder))


def _nearest(spark, folder):
    return flows.nearest_questions(views.request_vectors(spark, folder), views.document_vectors(spark, folder))


@query(
    "flow_retrieved_questions",
    with_views(BANK, REQUESTS, RETRIEVED)
    + "SELECT session_id, id, question, model_answer, round(distance, 6) AS distance, rank::INTEGER AS rank FROM retrieved",
)
def retrieved_questions(spark, folder):
    return _retrieved(spark, folder).withColumn("distance", F.round("distance", 6))


_REFERENCES = """listed AS (
  SELECT session_id, string_agg('- ' || question, chr(10) ORDER BY place) AS reference_questions
  FROM shuffled WHERE place <= 5 GROUP BY session_id)"""


@query("d7_reference_block", with_views(BANK, REQUESTS, RETRIEVED, _REFERENCES) + "SELECT * FROM listed")
def reference_block(spark, folder):
    return r.reference_block(_nearest(spark, folder), bank=views.bank(spark, folder))


@query(
    "p2_question_prompt",
    with_views(HISTORY, BANK, REQUESTS, RECENT, RETRIEVED, _REFERENCES)
    + f"""SELECT session_id, recent_avg, {sql_fill(
        fixed.QUESTION_PROMPT, profile_name="profile_name", experience="experience", role="role",
        question_type="coalesce(question_type, 'Technical')", resume="resume", reference_questions="reference_questions",
        tier=f"CASE WHEN recent_avg < 5 THEN {quoted(fixed.TIER_EASIER)} "
             f"WHEN recent_avg >= 8 THEN {quoted(fixed.TIER_HARDER)} ELSE '' END")} AS prompt
FROM (SELECT q.*, coalesce(a.recent_avg, 5.0) AS recent_avg, l.reference_questions FROM requests q
      JOIN listed l USING (session_id) LEFT JOIN recent a USING (session_id))""",
)
def question_prompt(spark, folder):
    near, bank = _nearest(spark, folder), views.bank(spark, folder)
    return flows.question_prompts(views.requests(spark, folder), near, views.history(spark, folder), bank=bank)


def _generated(spark, folder):
    """Customers as generated questions: fenced JSON, JSON in noise, an empty answer, or nothing."""
    key = F.col("c_custkey")
    whole = F.concat(F.lit('{"question": "Why '), "c_name", F.lit('?", "model_answer": "As '), "c_mktsegment", F.lit('"}'))
    raw = (
        F.when(key % 4 == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```")))
        .when(key % 4 == 1, F.concat(F.lit("Here: "), whole))
        .when(key % 4 == 2, F.concat(F.lit('{"question": "'), "c_name", F.lit('", "model_answer": ""}')))
    )
    return views.table(spark, folder, "customer").select(key.alias("session_id"), raw.alias("raw"))


@query(
    "c4_generated_or_static",
    with_views(BANK, REQUESTS, RETRIEVED)
    + """SELECT session_id, CASE WHEN good THEN 'Why ' || c_name || '?' ELSE question END AS question,
  CASE WHEN good THEN 'As ' || c_mktsegment ELSE model_answer END AS model_answer,
  CASE WHEN good THEN 'generated' ELSE 'static-rag' END AS source
FROM (SELECT s.*, c.c_name, c.c_mktsegment, c.c_custkey % 4 = 0 AS good
      FROM shuffled s JOIN customer c ON s.session_id = c.c_custkey WHERE place = 1)""",
)
def generated_or_static(spark, folder):
    return flows.generated_or_static(_nearest(spark, folder), _generated(spark, folder), bank=views.bank(spark, folder))


DIMS = 32


def _sql_places(x):
    words = f"regexp_split_to_array(lower({x}), '[ \\t\\n\\v\\f\\r]+')"
    return f"[('0x' || substr(md5(w), 1, 4))::BIGINT % {DIMS} FOR w IN {words} IF w <> '']"


def _sql_vector(places):
    return f"[len([p FOR p IN {places} IF p = d])::DOUBLE FOR d IN range({DIMS})]"


@query(
    "u1_embed_words",
    f"""SELECT doc_id, array_to_string([v::BIGINT FOR v IN {_sql_vector("places")}], ' ') AS counts
FROM (SELECT doc_id, {_sql_places("text")} AS places FROM documents)""",
)
def embed_words(spark, folder):
    """Every entry of every vector."""
    out = r.embed(views.table(spark, folder, "documents").select("doc_id", "text"), fn=r.hashed_words(DIMS))
    return out.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), " ").alias("counts"))


_DOCUMENT = sql_fill(fixed.DOCUMENT_TEXT, role="role", type="type", question="question")
_ASKED = sql_fill(fixed.QUERY_TEXT, role="role", resume="resume", question_type="coalesce(question_type, 'Technical')")


@query(
    "flow_embedded_retrieval",
    with_views(
        BANK,
        REQUESTS,
        f"""indexed AS (SELECT id, role, {_sql_vector("places")} AS v FROM (
  SELECT id, role, {_sql_places(_DOCUMENT)} AS places FROM bank))""",
        f"""asked AS (SELECT session_id, role, {_sql_vector("places")} AS v FROM (
  SELECT session_id, role, {_sql_places(_ASKED)} AS places FROM requests))""",
        """near AS (SELECT session_id, id, distance, row_number() OVER (PARTITION BY session_id ORDER BY distance, id)::INTEGER AS rank
  FROM (SELECT q.session_id, b.id, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(q.v, b.v)]) AS distance
    FROM asked q JOIN indexed b ON q.role = b.role))""",
    )
    + "SELECT session_id, id, distance, rank FROM near WHERE rank <= 20",
)
def embedded_retrieval(spark, folder):
    """Bank to an index with vectors and their search tree; query texts of all requests against what is stored."""
    path, fn = fresh_path(spark, "index"), r.hashed_words(DIMS)
    flows.load_embedded_index(views.bank(spark, folder), path, fn)
    return flows.nearest_by_text(views.requests(spark, folder), path, fn).select("session_id", "id", "distance", "rank")


@query("c1_knn_stored", "WITH " + _NEAR.format(distance=_SQUARED))
def knn_stored(spark, folder):
    """Vectors stored as a tree of several levels, then searched without the bank."""
    bank, path = views.vector_bank(spark, folder), fresh_path(spark, "tree")
    r.load_vectors(bank, path, cell_rows=32, fanout=8)
    asked = bank.select(F.col("id").alias("request"), "role", "embedding")
    near = r.nearest(asked, path, request_id="request")
    return near.select("request", "id", F.round("distance", 6).alias("distance"), "rank")
