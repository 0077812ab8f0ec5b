"""Difficulty tier after every answer, over a stream of scores."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prepbank import fixed
from prepbank.functions.exact import average, sum_parts
from prepbank.functions.text import difficulty_tier
from prepbank.operators.ordering import MAX_GROUP_ROWS, first_rows, rolling
from prepbank.streaming.clock import Clock

# Every so many micro-batches the kept scores are written whole; in between only those of the sessions that came up.
COMPACT_EVERY = 50
ID, SESSION, STAMP, SCORE = "id", "session_id", "timestamp", "score"


def adaptive_stream(
    stream: DataFrame,
    path: str,
    n: int = fixed.RECENT_SCORES,
    compact_every: int = COMPACT_EVERY,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    trigger: dict | None = None,
    late: str | None = None,
) -> StreamingQuery:
    """Start a query that writes every score of a stream ``id, session_id, score, timestamp`` with the last-n average and
    tier at that point to ``<path>/out``; ``read_adaptive`` reads it.

    Each micro-batch is the batch operator over its rows and the kept last n - 1 scores of their sessions, so a session
    with most rows of a micro-batch is split as any hot key. Rows of a micro-batch are put in (timestamp, id) order; a row
    that arrives in a later micro-batch counts as later.

    With ``late`` the order is that of event time: rows are held back in ``<path>/held`` until the watermark, ``late`` behind the largest
    stamp so far, has passed them, and take their places by (timestamp, id) whichever micro-batch brought them. Only a row that
    comes after the watermark has passed it counts as later than what was written. A micro-batch that is run again writes its own
    folders again.
    """
    clock = None if late is None else Clock(path, late)

    def step(batch: DataFrame, no: int) -> None:
        rows = batch.select(ID, SESSION, F.col(STAMP).cast("timestamp").alias(STAMP), F.col(SCORE).cast("double").alias(SCORE))
        if clock is not None:
            passed = clock.watermark(clock.tick(rows, STAMP, no))
            rows = rows.unionByName(_held(rows, path, no))
            early = F.coalesce(F.col(STAMP) > passed, F.lit(False))
            rows.where(early).write.mode("overwrite").parquet(f"{path}/held/{no}")
            rows = rows.where(~early)
        rows = rows.withColumn("_batch", F.lit(no).cast("bigint"))
        kept = _kept(rows, path, no, n, compact_every)
        both = _with_kept(rows, kept)
        _traced(both, no, n, max_group_rows).write.mode("overwrite").parquet(f"{path}/out/batch={no}")
        if n > 1:
            newest = [F.desc("_batch"), F.desc(STAMP), F.desc(ID)]
            all_rows = rows.unionByName(kept) if no % compact_every == 0 and no > 0 else both
            last = first_rows(all_rows, [SESSION], newest, n - 1, "_place", max_group_rows).drop("_place")
            last.write.mode("overwrite").parquet(f"{path}/kept/{no}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _held(rows: DataFrame, path: str, no: int) -> DataFrame:
    """Rows that are still held back after the micro-batch ahead of ``no``."""
    return rows.limit(0) if no == 0 else rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/held/{no - 1}")


def _with_kept(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows and the kept scores of their sessions."""
    here = rows.select(SESSION).distinct()
    return rows.unionByName(kept.join(here, kept[SESSION].eqNullSafe(here[SESSION]), "left_semi"))


def _traced(both: DataFrame, no: int, n: int, max_group_rows: int | None) -> DataFrame:
    """Averages and tiers of the rows of micro-batch ``no``."""
    parts = sum_parts(F.col(SCORE))
    traced = rolling(both, [SESSION], [F.asc("_batch"), F.asc(STAMP), F.asc(ID)], n, parts, max_group_rows)
    traced = traced.where(F.col("_batch") == no).withColumn("recent_avg", average(*map(F.col, parts))).drop("_batch", *parts)
    return traced.withColumn("tier", difficulty_tier(F.col("recent_avg")))


def _kept(rows: DataFrame, path: str, no: int, n: int, compact_every: int) -> DataFrame:
    """The last n - 1 scores of every session ahead of micro-batch ``no``: each session's newest entry since the last whole one."""
    if no == 0 or n == 1:
        return rows.limit(0)
    whole = (no - 1) // compact_every * compact_every
    read = rows.sparkSession.read.schema(rows.schema)
    # an entry repeats what its session keeps of older ones
    entries = [read.parquet(f"{path}/kept/{i}").withColumn("_of", F.lit(i).cast("bigint")) for i in range(whole, no)]
    found = entries[0]
    for entry in entries[1:]:
        found = found.unionByName(entry)
    newest = found.groupBy(F.col(SESSION).alias("_s")).agg(F.max("_of").alias("_newest"))
    same = found[SESSION].eqNullSafe(newest["_s"]) & (found["_of"] == newest["_newest"])
    return found.join(newest, same, "left_semi").drop("_of")


def read_adaptive(stream: DataFrame, path: str) -> DataFrame:
    """What the query has written so far: the scores of the stream with their averages and tiers."""
    spark = stream.sparkSession
    schema = f"{_row_schema(stream)}, recent_avg double, tier string"
    return spark.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out").drop("batch")


def pending_adaptive(
    stream: DataFrame, path: str, n: int = fixed.RECENT_SCORES, compact_every: int = COMPACT_EVERY,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """The rows that a query with ``late`` still holds back, as they will stand if no other row comes. Nothing is written; together
    with ``read_adaptive`` these are all scores of a stream that has ended."""
    spark = stream.sparkSession
    folders = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/held")
    listed = folders.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folders)
    no = 1 + max(int(f.getPath().getName()) for f in listed)
    rows = spark.read.schema(_row_schema(stream)).parquet(f"{path}/held/{no - 1}").withColumn("_batch", F.lit(no).cast("bigint"))
    return _traced(_with_kept(rows, _kept(rows, path, no, n, compact_every)), no, n, max_group_rows)


def _row_schema(stream: DataFrame) -> str:
    session, key = (stream.schema[c].dataType.simpleString() for c in (SESSION, ID))
    return f"{ID} {key}, {SESSION} {session}, {STAMP} timestamp, {SCORE} double"
