"""The score table: create, append, read, clear. Any number of writers append at a time, and an append that is run again adds nothing."""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepbank.operators.ordering import MAX_GROUP_ROWS, number_rows
from prepbank.session import materialize
from prepbank.sources.ledger import Files, Ledger, new_batch, safe_name

HISTORY_COLUMNS = "id BIGINT, session_id STRING, question STRING, score DOUBLE, timestamp TIMESTAMP"
BATCH = "batch"


def init_history(spark: SparkSession, table: str) -> None:
    """Create the score table if it is absent: the score columns, and the append that a row came with as a partition."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({HISTORY_COLUMNS}, {BATCH} STRING) USING parquet PARTITIONED BY ({BATCH})")


def log_scores(
    df: DataFrame, table: str, order: Sequence[str] = ("session_id", "question", "score"),
    max_group_rows: int | None = MAX_GROUP_ROWS, batch: str | None = None,
) -> bool:
    """Append ``session_id, question, score`` rows; ids go on from the last ones given out, in ``order``.

    The stamp is the row's own ``timestamp`` if it has one, else the time of the append in whole seconds. Ids are a range that the
    table's ledger gives to this append; the table is not read. ``batch`` names the append: one that has been published before
    returns False and adds nothing, one that stopped halfway is written anew under the same ids. Rows are seen from the moment that
    their partition is added to the catalog, all at once; what a stopped writer left behind is never seen.
    """
    spark = df.sparkSession
    batch = new_batch() if batch is None else batch
    if _published(spark, table, batch):
        return False
    # Read once, so that the count and the rows are of one state.
    rows = materialize(df, "append")
    first = _ledger(spark, table).claim(batch, rows.count())
    stamp = F.col("timestamp") if "timestamp" in df.columns else F.date_trunc("second", F.current_timestamp())
    numbered = number_rows(rows, [], [F.col(c) for c in order], "_no", max_group_rows=max_group_rows)
    numbered = numbered.select(
        (F.lit(first - 1) + F.col("_no")).cast("bigint").alias("id"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("question").cast("string").alias("question"),
        F.col("score").cast("double").alias("score"),
        stamp.cast("timestamp").alias("timestamp"),
    )
    # A folder of its own, as writers into one folder would clear each other's drafts away; the catalog takes it once.
    files, folder = Files(spark, _location(spark, table)), f"{BATCH}={safe_name(batch)}-{new_batch()}"
    numbered.write.parquet(f"{_location(spark, table)}/{folder}")
    try:
        spark.sql(f"ALTER TABLE {table} ADD PARTITION ({_partition(batch)}) LOCATION '{_location(spark, table)}/{folder}'")
    except AnalysisException as error:
        if error.getCondition() != "PARTITIONS_ALREADY_EXIST":
            raise
        files.drop(folder)
        return False
    return True


def read_history(spark: SparkSession, table: str) -> DataFrame:
    """The score rows: id, session_id, question, score, timestamp."""
    return spark.table(table).drop(BATCH)


def last_id(spark: SparkSession, table: str) -> int:
    """Last id ever given out, also to rows cleared since."""
    return _ledger(spark, table).last()


def clear_history(spark: SparkSession, table: str) -> None:
    """Delete all score rows. Neither ids nor the names of appends are given out again: one that is run again still adds nothing."""
    spark.sql(f"TRUNCATE TABLE {table}")


def _location(spark: SparkSession, table: str) -> str:
    described = {r[0]: r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()}
    return described["Location"].rstrip("/")


def _ledger(spark: SparkSession, table: str) -> Ledger:
    return Ledger(spark, f"{_location(spark, table)}/_ledger")


def _published(spark: SparkSession, table: str, batch: str) -> bool:
    return spark.sql(f"SHOW PARTITIONS {table} PARTITION ({_partition(batch)})").head() is not None


def _partition(batch: str) -> str:
    return f"{BATCH} = '{safe_name(batch)}'"
