"""Event time of a stream whose micro-batches are run by ``foreachBatch``: how far it has come, kept beside the results."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Clock:
    """Largest stamp up to each micro-batch, one row in ``<path>/clock/<no>``; a micro-batch that is run again writes its own again."""

    def __init__(self, path: str, late: str):
        self.path, self.late = path, late

    def before(self, spark, no: int) -> int | None:
        """Microseconds up to the micro-batch ahead of ``no``, None if there was no stamp yet."""
        if no == 0:
            return None
        return spark.read.schema("at bigint").parquet(f"{self.path}/clock/{no - 1}").head()[0]

    def tick(self, rows: DataFrame, ts: str, no: int) -> int | None:
        """Take the stamps of micro-batch ``no`` in."""
        spark = rows.sparkSession
        seen = rows.agg(F.max(F.unix_micros(ts))).head()[0]
        now = max((x for x in (seen, self.before(spark, no)) if x is not None), default=None)
        spark.createDataFrame([(now,)], "at bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/clock/{no}")
        return now

    def watermark(self, at: int | None) -> Column:
        """Stamp that no row on time is older than; null while there is none."""
        return F.timestamp_micros(F.lit(at).cast("bigint")) - F.expr(f"INTERVAL {self.late}")
