"""Helpers shared by the operators of this subpackage."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Most buckets that one key is numbered in. More rows make larger buckets; no row is left out.
MAX_BUCKETS = 65_536


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def restored(df: DataFrame, like: DataFrame, id_col: str) -> DataFrame:
    """Column ``id``, which went through Python as text so that nulls don't cost digits, in its own type again."""
    return df.withColumn("id", F.col("id").cast(like.schema[id_col].dataType))



def number_in_buckets(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence, name: str) -> DataFrame:
    """Gapless numbers from 0 within each key, in the order (bucket, order).

    ``bucket`` is a column that spreads the rows of every key. The window runs over (keys, bucket), so no task holds
    a whole key; the offsets come from pre-aggregated counts, of which a key has at most as many as buckets. Null
    keys form a group of their own.
    """
    by = [*keys, bucket]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ahead = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)],
        F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"),
    )
    ranked = df.withColumn("__at", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)))
    return (
        ranked.join(offsets, on)
        .withColumn(name, (F.col("__ahead") + F.col("__at") - 1).cast("bigint"))
        .drop("__at", "__ahead", *[f"__k{i}" for i in range(len(by))])
    )
