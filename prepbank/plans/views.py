"""The given tables seen as the package's model tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST_ROLES = ["en", "fr", "de", "es", "xx"]
REQUEST_LEVELS = ["Junior", "Mid", "Senior"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scored answers."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("question"),
        F.least(F.col("value") / 10, F.lit(10.0)).alias("score"),
        F.col("ts").alias("timestamp"),
    )


def bank(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents as bank rows: the language stands for the role."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("role"),
        F.col("source").alias("category"),
        F.col("text").alias("question"),
        F.when(F.col("quality") == 1, "Technical").otherwise("Behavioral").alias("type"),
        F.concat(F.lit("See "), F.col("source"), F.lit(".")).alias("model_answer"),
    )


def vector_bank(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors as an index: the label stands for the role."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("role"), F.col("embedding")
    )


def _with_vector(rows: DataFrame, spark: SparkSession, folder: str, key: str) -> DataFrame:
    """Every row with a stored vector: the ids of the vectors run from 0, and a key takes the one at its remainder."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    total = vectors.count()
    return rows.withColumn("_vec", F.pmod(F.col(key), F.lit(total))).join(vectors, "_vec").drop("_vec")


def document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All bank rows, each with a stored vector."""
    return _with_vector(bank(spark, folder), spark, folder, "id")


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as session requests; every third names no question type."""
    key = F.col("c_custkey")

    def one_of(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))

    kind = F.when(key % 3 == 1, "Technical").when(key % 3 == 2, "Behavioral")
    return table(spark, folder, "customer").select(
        key.alias("session_id"),
        F.col("c_name").alias("profile_name"),
        one_of(REQUEST_ROLES).alias("role"),
        one_of(REQUEST_LEVELS).alias("experience"),
        F.concat_ws(" ", F.lit("Works in"), F.lower("c_mktsegment"), F.lit("as account"), key.cast("string")).alias(
            "resume"
        ),
        kind.alias("question_type"),
    )


def request_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All requests, each with a stored vector."""
    return _with_vector(requests(spark, folder), spark, folder, "session_id")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Events as generated texts: JSON in noise, with nothing in it, broken, or missing."""
    key = F.col("event_id")
    score = F.col("value").cast("string")
    whole = F.concat(
        F.lit('Sure: {"score": '), score, F.lit(', "summary": "'), F.col("event_type"),
        F.lit('", "strengths": ["a '), F.col("event_type"), F.lit('", "b"], "extra": '), F.col("props"),
        F.lit("} done"),
    )
    raw = (
        F.when(key % 6 == 0, whole)
        .when(key % 6 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(key % 6 == 2, F.concat(F.lit("no payload for "), F.col("event_type")))
        .when(key % 6 == 3, F.concat(F.lit("broken "), F.col("props"), F.lit(" } end")))
        .when(key % 6 == 4, F.concat(F.lit('{"score": "'), score, F.lit('/10"}')))
        .otherwise("")
    )
    return table(spark, folder, "events").select(
        key.alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("question"),
        F.col("ts").alias("timestamp"), raw.alias("raw"),
    )


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as ordered text parts."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("key"), F.col("turn").alias("part"), F.col("text")
    )


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests: the type is the endpoint, the user the caller."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("caller"), F.col("event_type").alias("endpoint"), "ts"
    )
