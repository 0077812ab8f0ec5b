"""Intermediate tables leave no shuffle files."""

import os
import threading

from pyspark.sql import functions as F

from prepbank import session


def shuffle_bytes(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    found = (os.path.join(at, name) for top in folders for at, _, names in os.walk(top.getPath()) for name in names)
    return sum(os.path.getsize(x) for x in found if os.path.basename(x).startswith("shuffle_"))


def test_materialize_leaves_no_shuffle_files(spark):
    rows = spark.range(400_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("h"))
    before = shuffle_bytes(spark)
    kept = session.materialize(rows.groupBy("h").agg(F.max("id").alias("id")), "kept")
    # removal runs behind the query
    for _ in range(50):
        if shuffle_bytes(spark) - before < 1 << 20:
            break
        threading.Event().wait(0.1)
    assert shuffle_bytes(spark) - before < 1 << 20
    assert kept.agg(F.count("h"), F.sum("id")).head() == (400_000, 400_000 * 399_999 // 2)
    assert spark.conf.get(session.CLEANUP, "false") == "false"


def test_materialize_in_threads_and_again(spark):
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    found = []
    threads = [threading.Thread(target=lambda: found.append(sorted(session.materialize(rows, "some").collect()))) for _ in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert found == [sorted(rows.collect())] * 4
    assert spark.conf.get(session.CLEANUP, "false") == "false"


def test_a_session_that_cleans_up_by_itself(spark):
    spark.conf.set(session.CLEANUP, "true")
    try:
        assert session.materialize(spark.range(5), "five").count() == 5
        assert spark.conf.get(session.CLEANUP) == "true"
    finally:
        spark.conf.set(session.CLEANUP, "false")
