"""Session settings and the shared folder."""

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's own removal of the shuffle files of a query that has ended, and the sessions that have it on for now.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning, _turn = Counter(), threading.Lock()


def build_session(master: str | None = None, name: str = "prepbank", **conf: str) -> SparkSession:
    """Session with the settings the package counts on; ``conf`` entries win."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local session that names none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="prepbank-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/prepbank/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """New path inside the application's part of the shared folder."""
    return f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables that this application has written, and the databases that lie among them.

    Results that were not written elsewhere cannot be read any more after it.
    """
    own = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    for row in spark.sql("SHOW DATABASES LIKE 'prepbank_*'").collect():
        described = spark.sql(f"DESCRIBE DATABASE {row[0]}").collect()
        if own.toUri().getPath() + "/" in {r[0]: r[1] for r in described}["Location"]:
            spark.sql(f"DROP DATABASE {row[0]} CASCADE")
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries in here leave no shuffle files; any number of threads may be in here at a time."""
    own = spark._jsparkSession.sessionUUID()
    with _turn:
        # one that has it on by itself keeps it
        switched = _cleaning[own] > 0 or spark.conf.get(CLEANUP, "false") != "true"
        if switched:
            _cleaning[own] += 1
            spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _turn:
            if switched:
                _cleaning[own] -= 1
                if not _cleaning[own]:
                    spark.conf.set(CLEANUP, "false")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: a short lineage that outlives lost executors,
    a result fixed across later reads, and columns that later reads can prune. Shuffle files of the write go with its end."""
    path = fresh_path(df.sparkSession, label)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
