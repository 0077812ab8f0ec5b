"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepbank.llm.common import MAX_BUCKETS, number_in_buckets

# Prime modulus of the per-shard hashes; products of two residues fit in a bigint.
PRIME = 2**31 - 1
# Rows to a bucket of the numbering, over all shards together.
BUCKET_ROWS = 2048


def shard_constants(shard: int) -> tuple[int, int]:
    """Multiplier and offset of a shard's hash; they depend on the shard's number alone."""
    digest = hashlib.md5(f"shard {shard}".encode()).digest()
    return int.from_bytes(digest[:8], "big") % (PRIME - 1) + 1, int.from_bytes(digest[8:], "big") % PRIME


def key_hash(key: Column) -> Column:
    """Residue of a record key, from the first 8 hex digits of its md5; a null key counts as ''."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % PRIME


def rendezvous(hashed: Column, weights: Sequence[float]) -> Column:
    """Shard with the highest score -weight / ln(u), u the shard's own hash of the key in (0, 1); ties go to the smaller shard.

    A further shard only adds one score, so it takes rows for itself and no row moves between the others.
    """
    scores = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            raise ValueError("weights must be positive")
        a, b = shard_constants(shard)
        u = ((hashed * F.lit(a).cast("bigint") + F.lit(b).cast("bigint")) % PRIME + F.lit(0.5)) / F.lit(float(PRIME))
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("back")))
    return -F.array_max(F.array(*scores))["back"]


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weight: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot, grown_shard.

    The shard follows from the key and the weights alone; ``grown_shard`` is the shard if one more of ``grown_weight``
    joins. Slots are gapless from 0 in each shard, in the order (bucket of the key's hash, key, crc), so no task
    numbers a whole shard. Texts are not shuffled.

    Null keys go where the key '' goes; a null text has size 8 and crc 0, as an empty one; repeated rows get the same
    shard and slots of their own; an empty table gives an empty result; other columns take no part.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key_hash(F.col(id_col)).alias("hashed"),
    )
    buckets = F.lit(min(MAX_BUCKETS, max(1, -(-docs.count() // bucket_rows))))
    placed = slim.withColumns({
        "shard": rendezvous(F.col("hashed"), weights),
        "grown_shard": rendezvous(F.col("hashed"), [*weights, grown_weight]),
        "bucket": F.col("hashed") % buckets,
    })
    numbered = number_in_buckets(placed, ["shard"], "bucket", ["id", "text_crc32", "size"], "slot")
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], id_col: str = "doc_id", files: int = 1) -> None:
    """Write the rows into folders ``shard=k`` of Parquet, each spread over ``files`` tasks by the key's hash."""
    hashed = key_hash(F.col(id_col))
    placed = docs.withColumn("shard", rendezvous(hashed, weights))
    placed.repartition(len(weights) * files, "shard", hashed % files).write.partitionBy("shard").parquet(path)
