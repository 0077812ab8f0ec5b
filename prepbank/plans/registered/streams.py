"""Rate audit and the score stream. The streams read the events table as a file source until it is used up."""

from pyspark.sql import functions as F

from prepbank import fixed
from prepbank.plans import views
from prepbank.plans.registered.base import query
from prepbank.plans.registered.scores import ADAPTIVE_SQL
from prepbank.session import fresh_path
from prepbank.streaming import adaptive, limits


def _event_stream(spark, folder):
    schema = views.table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def _run(stream, spark, label):
    """Run a stream over all there is and read its sink."""
    path = fresh_path(spark, label)
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    writer.option("checkpointLocation", path + "/state").start(path + "/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out")


@query(
    "s1_rate_limit_audit",
    """SELECT id, endpoint, window_start, rn <= 5 AS allowed FROM (
  SELECT event_id AS id, event_type AS endpoint, date_trunc('hour', ts) AS window_start,
    row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn FROM events)""",
)
def rate_limit_audit(spark, folder):
    audit = limits.rate_limit_audit(views.request_log(spark, folder), "endpoint", "ts", 5, "1 hour")
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return audit.select("id", "endpoint", start, "allowed")


_LIMITED = f"""limited AS (SELECT event_id AS id, user_id AS caller, ts, e.endpoint, e.most FROM events
  JOIN (VALUES {", ".join(f"({i}, '{k}', {v})" for i, (k, v) in enumerate(fixed.RATE_LIMITS.items()))}) AS e(n, endpoint, most)
  ON event_id % {len(fixed.RATE_LIMITS)} = e.n)"""


def _limited(spark, folder):
    return _as_limited(views.table(spark, folder, "events"))


def _as_limited(events):
    """Events as requests of a caller to an endpoint, each with the endpoint's limit."""
    names = F.array(*[F.lit(k) for k in fixed.RATE_LIMITS])
    most = F.array(*[F.lit(v) for v in fixed.RATE_LIMITS.values()])
    at = (F.col("event_id") % len(fixed.RATE_LIMITS) + 1).cast("int")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("caller"), F.element_at(names, at).alias("endpoint"),
        F.element_at(most, at).alias("most"), F.col("ts").cast("timestamp").alias("ts"),
    )


@query(
    "s1_rate_limit_by_endpoint",
    f"""WITH {_LIMITED} SELECT id, caller, endpoint, window_start, rn <= most AS allowed FROM (
  SELECT id, caller, endpoint, most, date_trunc('day', ts) AS window_start,
    row_number() OVER (PARTITION BY caller, endpoint, date_trunc('day', ts) ORDER BY ts, id) AS rn FROM limited)""",
)
def rate_limit_by_endpoint(spark, folder):
    """Requests of each caller to each endpoint, held against the endpoint's own limit."""
    audit = limits.rate_limit_audit(_limited(spark, folder), ["caller", "endpoint"], "ts", "most", "1 day")
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return audit.select("id", "caller", "endpoint", start, "allowed")


@query(
    "s1_rate_decisions_stream",
    f"""WITH {_LIMITED} SELECT id, caller, endpoint, window_start, rn <= most AS allowed FROM (
  SELECT id, caller, endpoint, most, date_trunc('day', ts) AS window_start,
    row_number() OVER (PARTITION BY caller, endpoint, date_trunc('day', ts) ORDER BY ts, id) AS rn FROM limited)""",
)
def rate_decisions_stream(spark, folder):
    """The same decisions, each request decided as the stream of events brings it."""
    log = _as_limited(_event_stream(spark, folder))
    path = fresh_path(spark, "decisions")
    limits.rate_decisions(log, path, ["caller", "endpoint"], "ts", "most", "1 day").awaitTermination()
    start = F.col("window_start").cast("timestamp_ntz").alias("window_start")
    return limits.read_decisions(log, path, "ts").select("id", "caller", "endpoint", start, "allowed")


@query(
    "s1_rate_limit_counts_by_endpoint",
    f"""WITH {_LIMITED} SELECT caller, endpoint, date_trunc('day', ts) AS window_start, count(*) AS requests,
  greatest(count(*) - any_value(most), 0) AS rejected FROM limited GROUP BY 1, 2, 3""",
)
def rate_limit_counts_by_endpoint(spark, folder):
    counted = limits.rate_limit_counts(_limited(spark, folder), ["caller", "endpoint"], "ts", "most", "1 day")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_COUNTS = """SELECT event_type AS endpoint, date_trunc('hour', ts) AS window_start, count(*) AS requests,
  greatest(count(*) - 5, 0) AS rejected FROM events GROUP BY 1, 2"""


@query("s1_rate_limit_counts", _COUNTS)
def rate_limit_counts(spark, folder):
    log = views.request_log(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = limits.rate_limit_counts(log, "endpoint", "ts", 5, "1 hour")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "s1_rate_limit_stream",
    _COUNTS + " HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)",
)
def rate_limit_stream(spark, folder):
    """Windows that are final when the events end; those still open at the watermark give no row yet."""
    log = _event_stream(spark, folder).select(F.col("event_type").alias("endpoint"), "ts")
    final = _run(limits.rate_limit_stream(log, "endpoint", "ts", 5, "1 hour"), spark, "limits")
    return final.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _score_stream(spark, folder):
    return _event_stream(spark, folder).select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("session_id"),
        F.least(F.col("value") / 10, F.lit(10.0)).alias("score"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


@query("s2_adaptive_event_time", ADAPTIVE_SQL)
def adaptive_event_time(spark, folder):
    """Scores held back for a day of event time: what the stream has written, and what it still holds when the events end."""
    scores, path = _score_stream(spark, folder), fresh_path(spark, "adaptive")
    adaptive.adaptive_stream(scores, path, late="1 day").awaitTermination()
    traced = adaptive.read_adaptive(scores, path).unionByName(adaptive.pending_adaptive(scores, path))
    return traced.select("id", "session_id", "recent_avg", "tier")


@query("s2_adaptive_stream", ADAPTIVE_SQL)
def adaptive_stream(spark, folder):
    scores, path = _score_stream(spark, folder), fresh_path(spark, "adaptive")
    adaptive.adaptive_stream(scores, path).awaitTermination()
    traced = adaptive.read_adaptive(scores, path)
    return traced.select("id", "session_id", "recent_avg", "tier")
