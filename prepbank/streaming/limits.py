"""Request-rate audit in fixed windows, in batch and over a stream: decisions on each request, and counts."""

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from prepbank.operators.ordering import MAX_GROUP_ROWS, find_hot_keys, first_rows, lookup, split_hot
from prepbank.streaming.clock import Clock


def _window_start(ts: str, window: str) -> Column:
    return F.window(F.col(ts).cast("timestamp"), window)["start"]


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _limit(limit: int | str) -> Column:
    return F.lit(limit) if isinstance(limit, int) else F.col(limit)


def rate_limit_audit(
    df: DataFrame,
    key: str | Sequence[str],
    ts: str,
    limit: int | str,
    window: str = "1 minute",
    id_col: str = "id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Mark the first ``limit`` requests of a key in each window allowed, the rest rejected.

    ``key`` is a column or several (caller and endpoint); ``limit`` is a number or a column that is the same for all requests
    of a key. Windows of ordinary size are numbered. In a hot one only the first ``limit`` rows leave an input task; the last
    of them is the cut that every request of the window is held against, in place.
    """
    keys = [*_keys(key), "window_start"]
    stamped = df.withColumn("window_start", _window_start(ts, window)).withColumn("_limit", _limit(limit))
    w = W.partitionBy(*keys).orderBy(ts, id_col)

    def numbered(part):
        return part.withColumn("allowed", F.row_number().over(w) <= F.col("_limit")).drop("_limit")

    hot = find_hot_keys(stamped, keys, max_group_rows)
    if hot is None:
        return numbered(stamped)
    cold, rest = split_hot(stamped, keys, hot)
    most = limit if isinstance(limit, int) else rest.agg(F.max("_limit")).head()[0] or 0
    slim = rest.select(*keys, ts, id_col, "_limit")
    first = first_rows(slim, keys, [F.asc(ts), F.asc(id_col)], most, "_no", max_group_rows).where(F.col("_no") <= F.col("_limit"))
    cut = first.groupBy(*keys).agg(F.max_by(F.struct(ts, id_col), "_no").alias("_cut"))
    held = lookup(rest, cut, keys, "left", max_group_rows)
    held = held.withColumn("allowed", F.coalesce(F.struct(ts, id_col) <= F.col("_cut"), F.lit(False)))
    return numbered(cold).unionByName(held.select(*[c for c in stamped.columns if c != "_limit"], "allowed"))


def rate_limit_counts(df: DataFrame, key: str | Sequence[str], ts: str, limit: int | str, window: str = "1 minute") -> DataFrame:
    """Requests and rejections per key and window. Works on a batch, and on a stream that has a watermark."""
    counted = df.groupBy(F.window(F.col(ts), window).alias("_w"), *_keys(key)).agg(
        F.count(F.lit(1)).alias("requests"), F.max(_limit(limit)).alias("_limit")
    )
    return counted.select(
        *_keys(key),
        F.col("_w.start").alias("window_start"),
        "requests",
        F.greatest(F.col("requests") - F.col("_limit"), F.lit(0)).cast("bigint").alias("rejected"),
    )


def rate_limit_stream(
    stream: DataFrame, key: str | Sequence[str], ts: str, limit: int | str, window: str = "1 minute", late: str = "1 minute"
) -> DataFrame:
    """Streaming form; a window's row is final once the watermark passes it (append mode), later windows are still open."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rate_limit_counts(stamped, key, ts, limit, window)


def rate_decisions(
    stream: DataFrame,
    path: str,
    key: str | Sequence[str],
    ts: str,
    limit: int | str,
    window: str = "1 minute",
    late: str = "1 minute",
    id_col: str = "id",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that decides on every request of a stream and writes it, allowed or rejected, to ``<path>/out``;
    ``read_decisions`` reads it.

    The state is one count for each key and window that has allowed requests: ``<path>/used/<no>`` after micro-batch ``no``. A
    micro-batch is the batch audit with what is left of each limit, so a hot window is split as there. Requests are decided in
    order of (``ts``, ``id_col``) within a micro-batch and never taken back, which on input in order of time is the batch audit.
    A count is dropped once the watermark, ``late`` behind the largest stamp, has passed the end of its window; a request for
    such a window is rejected. A micro-batch that is run again writes its own folders again.
    """
    keys = [*_keys(key), "window_start"]
    clock = Clock(path, late)

    def step(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("window_start", _window_start(ts, window))
        passed = clock.watermark(clock.before(spark, no))
        now = clock.watermark(clock.tick(rows, ts, no))
        used = _used(rows, keys, path, no)
        held = used.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("used").alias("_used"))
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
        left = F.greatest(_limit(limit) - F.coalesce("_used", F.lit(0)), F.lit(0))
        open_ = ~F.coalesce(_end(window) <= passed, F.lit(False))
        met = rows.join(held, same, "left").withColumn("_left", F.when(open_, left).otherwise(0).cast("int"))
        met = met.drop("_used", "window_start", *[f"_k_{k}" for k in keys])
        audit = rate_limit_audit(met, key, ts, "_left", window, id_col, max_group_rows).drop("_left")
        audit.write.mode("overwrite").parquet(f"{path}/out/batch={no}")
        decided = spark.read.schema(audit.schema).parquet(f"{path}/out/batch={no}")
        fresh = decided.where("allowed").groupBy(*keys).agg(F.count(F.lit(1)).alias("used"))
        counts = used.unionByName(fresh).groupBy(*keys).agg(F.sum("used").alias("used"))
        counts.where(~F.coalesce(_end(window) <= now, F.lit(False))).write.mode("overwrite").parquet(f"{path}/used/{no}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _end(window: str) -> Column:
    return F.col("window_start") + F.expr(f"INTERVAL {window}")


def _used(rows: DataFrame, keys: Sequence[str], path: str, no: int) -> DataFrame:
    """Requests allowed so far by key and open window."""
    none = rows.limit(0).select(*keys, F.lit(0).cast("bigint").alias("used"))
    return none if no == 0 else rows.sparkSession.read.schema(none.schema).parquet(f"{path}/used/{no - 1}")


def read_decisions(stream: DataFrame, path: str, ts: str) -> DataFrame:
    """The requests decided so far, with ``window_start`` and ``allowed``."""
    fields = [f"`{f.name}` {'timestamp' if f.name == ts else f.dataType.simpleString()}" for f in stream.schema]
    schema = ", ".join([*fields, "window_start timestamp", "allowed boolean"])
    return stream.sparkSession.read.schema(schema).option("basePath", f"{path}/out").parquet(f"{path}/out").drop("batch")
