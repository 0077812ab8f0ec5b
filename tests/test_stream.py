"""Streams over several micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from prepbank.operators import history as h
from prepbank.session import fresh_path
from prepbank.streaming import adaptive, limits


@pytest.fixture(scope="module")
def log(spark):
    return spark.range(900).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 17))).alias("session_id"),
        (F.pmod(F.xxhash64("id"), F.lit(101)) / 10).alias("score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("timestamp"),
    )


@pytest.fixture(scope="module")
def source(spark, log):
    """Six files in time order, one per micro-batch."""
    path = fresh_path(spark, "stream-in")
    for no in range(6):
        log.where(F.col("id").between(no * 150, no * 150 + 149)).orderBy(F.rand(no)).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, stream):
    path = fresh_path(spark, "stream-out")
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    query = writer.option("checkpointLocation", path + "/state").start(path + "/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path + "/out"), len(query.recentProgress)


def opened(spark, log, source):
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("n, compact, limit", [(1, 50, 1_000_000), (3, 50, 1_000_000), (3, 2, 20), (5, 1, 3)])
def test_adaptive_stream_equals_the_batch_trace(spark, log, source, n, compact, limit):
    """A third of all rows in one session; the kept scores whole at every, every second and no further micro-batch."""
    path = fresh_path(spark, "stream-out")
    stream = opened(spark, log, source)
    query = adaptive.adaptive_stream(stream, path, n, compact, limit)
    query.awaitTermination()
    assert len(query.recentProgress) >= 6
    columns = ["id", "session_id", F.round("recent_avg", 9).alias("a"), "tier"]
    got = sorted(tuple(r) for r in adaptive.read_adaptive(stream, path).select(*columns).collect())
    assert got == sorted(tuple(r) for r in h.adaptive_trace(log, n).select(*columns).collect())


def test_rate_limit_stream_equals_the_batch_counts(spark, log, source):
    streamed, _ = run(spark, limits.rate_limit_stream(opened(spark, log, source), "session_id", "timestamp", 2))
    counts = {(r["session_id"], r["window_start"]): r for r in limits.rate_limit_counts(log, "session_id", "timestamp", 2).collect()}
    got = streamed.collect()
    last = log.agg(F.max("timestamp")).first()[0]
    assert len(got) >= 0.9 * len(counts)
    assert {(r["session_id"], r["window_start"]) for r in got} == {
        key for key in counts if (last - key[1]).total_seconds() >= 120
    }
    assert all(r == counts[r["session_id"], r["window_start"]] for r in got)


@pytest.mark.parametrize("limit", [1_000_000, 20, 2])
def test_audit(spark, log, limit):
    audit = limits.rate_limit_audit(log, "session_id", "timestamp", 5, "10 minutes", max_group_rows=limit).collect()
    assert len(audit) == 900
    seen = {}
    for r in sorted(audit, key=lambda r: (r["timestamp"], r["id"])):
        key = (r["session_id"], r["window_start"])
        seen[key] = seen.get(key, 0) + 1
        assert r["allowed"] == (seen[key] <= 5)
    counts = limits.rate_limit_counts(log, "session_id", "timestamp", 5, "10 minutes")
    assert counts.agg(F.sum("rejected")).first()[0] == sum(not r["allowed"] for r in audit)


def test_rate_decisions_equal_the_batch_audit(spark, log, source):
    """Input in order of time over six micro-batches, a third of it of one caller; counts of windows that have passed are gone."""
    limited = opened(spark, log, source).withColumn("most", F.lit(5))
    for limit, group in ((5, 1_000_000), ("most", 20)):
        path = fresh_path(spark, "decisions")
        query = limits.rate_decisions(limited, path, ["session_id"], "timestamp", limit, "10 minutes", max_group_rows=group)
        query.awaitTermination()
        assert len(query.recentProgress) >= 6
        columns = ["id", "session_id", "window_start", "allowed"]
        got = limits.read_decisions(limited, path, "timestamp").select(*columns).collect()
        wanted = limits.rate_limit_audit(log, "session_id", "timestamp", 5, "10 minutes").select(*columns).collect()
        assert sorted(got) == sorted(wanted) and len(got) == 900
        last = log.agg(F.max("timestamp")).first()[0]
        for no in range(6):
            kept = spark.read.parquet(f"{path}/used/{no}").collect()
            assert kept and max(r["used"] for r in kept) <= 5
            newest = log.where(F.col("id") <= no * 150 + 149).agg(F.max("timestamp")).first()[0]
            assert all((newest - r["window_start"]).total_seconds() < 660 for r in kept)
        assert all((last - r["window_start"]).total_seconds() < 660 for r in kept)


def test_late_requests_and_null_callers(spark):
    """A request for a window whose count is gone is rejected; one that is late for an open window is decided; a null caller is a caller."""
    schema = "id bigint, caller string, ts timestamp"
    source = fresh_path(spark, "late-in")
    start = 1_700_000_040
    batches = [
        [(0, "a", 0), (1, "a", 5), (2, None, 6), (3, None, 7), (4, None, 8)],
        [(5, "a", 50), (6, None, 20), (7, "b", 200)],
        [(8, "a", 30), (9, "b", 150), (10, "b", 205), (11, "b", 206)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, "id bigint, caller string, at bigint").select(
            "id", "caller", F.timestamp_seconds(F.lit(start) + F.col("at")).alias("ts")
        ).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    path = fresh_path(spark, "late")
    limits.rate_decisions(stream, path, "caller", "ts", 2, "1 minute", "1 minute").awaitTermination()
    got = {r["id"]: r["allowed"] for r in limits.read_decisions(stream, path, "ts").collect()}
    rejected = {4, 5, 6, 8, 11}
    assert got == {i: i not in rejected for i in range(12)}
    assert {r["caller"] for r in spark.read.parquet(f"{path}/used/2").collect()} == {"b"}


@pytest.mark.parametrize("n, compact, limit", [(3, 50, 1_000_000), (4, 2, 20)])
def test_scores_in_event_time(spark, log, n, compact, limit):
    """Rows arrive up to 40 places (280 s) out of order, over six micro-batches; they take their places all the same."""
    source = fresh_path(spark, "stream-in")
    arrival = log.withColumn("_at", F.col("id") + F.pmod(F.xxhash64("id", F.lit("late")), F.lit(40))).orderBy("_at", "id").drop("_at")
    rows = arrival.collect()
    assert [r["id"] for r in rows] != sorted(r["id"] for r in rows)
    for no in range(6):
        spark.createDataFrame(rows[no * 150 : no * 150 + 150], log.schema).coalesce(1).write.mode("append").parquet(source)
    stream = opened(spark, log, source)
    columns = ["id", "session_id", "recent_avg", "tier"]
    wanted = sorted(tuple(r) for r in h.adaptive_trace(log, n).select(*columns).collect())

    def traced(late):
        path = fresh_path(spark, "stream-out")
        query = adaptive.adaptive_stream(stream, path, n, compact, limit, late=late)
        query.awaitTermination()
        assert len(query.recentProgress) >= 6
        out = adaptive.read_adaptive(stream, path).select(*columns)
        held = 0
        if late:
            pending = adaptive.pending_adaptive(stream, path, n, compact, limit).select(*columns)
            held, out = pending.count(), out.unionByName(pending)
        return sorted(tuple(r) for r in out.collect()), held

    got, held = traced("280 seconds")
    assert got == wanted and 0 < held < 60
    assert traced(None)[0] != wanted
