"""Numbering, rolling aggregates and lookups that hold when one key owns a large share of the rows.

Groups of ordinary size take the plain Spark plan (a window over the key, an equi join). Keys with more
rows than ``max_group_rows`` are found first by one pre-aggregated count over the key columns alone.
Their rows are cut into runs by a range partitioning on (key, order), so no task holds a whole hot group,
and every row is kept.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from prepbank.session import materialize

MAX_GROUP_ROWS = 1_000_000
# The same in bytes, for groups of whole texts.
MAX_GROUP_BYTES = 256 << 20
# Up to this many hot keys are sent to every task as a list; more of them are a table of their own that is joined.
HOT_KEY_LIMIT = 10_000
# Spark keeps only the first rows of each key ahead of a shuffle up to this many (its own default limit).
GROUP_LIMIT = 1000
# Largest side that a lookup broadcasts, in counted bytes of its rows.
BROADCAST_BYTES = 64 << 20
# Copies of the right rows of hot keys, where these are too large for a broadcast.
SALTS = 64


class HotKeys:
    """Hot keys of a frame (``frame``), with their rows (``sized``), and the sum of rows."""

    def __init__(self, sized: DataFrame, keys: Sequence[str], rows: int, few: bool):
        self.sized = F.broadcast(sized) if few else sized
        self.frame = F.broadcast(sized.select(*keys)) if few else sized.select(*keys)
        self.rows = rows
        self.few = few


def find_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    max_group_rows: int | None = MAX_GROUP_ROWS,
    weight: Column | None = None,
    sizes: DataFrame | None = None,
) -> HotKeys | None:
    """Keys with more than ``max_group_rows`` rows (or that sum of ``weight``), or None.

    None for the limit skips the count, for groups that are known to be small. ``sizes`` are the ready counts of a frame whose rows
    have been counted before: the keys, each once, and ``_rows``.
    """
    if max_group_rows is None:
        return None
    if sizes is None:
        rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
        sizes = df.groupBy(*keys).agg(rows.cast("bigint").alias("_rows"))
    counted = sizes.select(*keys, "_rows").where(F.col("_rows") > max_group_rows)
    found = counted.limit(HOT_KEY_LIMIT + 1).collect()
    if not found:
        return None
    if len(found) > HOT_KEY_LIMIT:
        sized = materialize(counted, "hot")
        return HotKeys(sized, keys, sized.agg(F.sum("_rows")).head()[0], False)
    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("_rows", T.LongType())])
    sized = df.sparkSession.createDataFrame([tuple(r) for r in found], schema)
    return HotKeys(sized, keys, sum(r["_rows"] for r in found), True)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(cold rows, hot rows)."""
    few = hot.frame
    return df.join(few, _same_key(df, few, keys), "left_anti"), df.join(few, _same_key(df, few, keys), "left_semi")


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_no",
    head: dict[str, Column] | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Row numbers from 1 within each key, in ``order``, which must be total within a key.

    ``head`` adds columns holding a value of the key's first row. With no keys all rows form one group. ``sizes``: see ``find_hot_keys``.
    """
    head = head or {}
    keys = list(keys)
    if head and not keys:
        raise ValueError("head needs keys")
    if keys:
        hot = find_hot_keys(df, keys, max_group_rows, sizes=sizes)
        if hot is None:
            return _number_by_window(df, keys, order, name, head)
        cold, rest = split_hot(df, keys, hot)
        return _number_by_window(cold, keys, order, name, head).unionByName(
            _number_by_ranges(rest, keys, order, name, head, hot.rows, max_group_rows, hot.few)
        )
    rows = df.count() if max_group_rows is not None else 0
    if max_group_rows is None or rows <= max_group_rows:
        return _number_by_window(df, keys, order, name, head)
    return _number_by_ranges(df, keys, order, name, head, rows, max_group_rows)


def _number_by_window(df, keys, order, name, head):
    w = W.partitionBy(*keys).orderBy(*order)
    firsts = [F.first(c).over(w).alias(n) for n, c in head.items()]
    return df.select("*", F.row_number().over(w).cast("bigint").alias(name), *firsts)


def _number_by_ranges(df, keys, order, name, head, rows, max_group_rows, few=True):
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // max_group_rows))
    ranked = (
        df.repartitionByRange(parts, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ranked = materialize(ranked, "runs").withColumn("_run", F.shiftright("_at", 33))
    # One row per run of a key: at most (partitions + hot keys) rows, safe to broadcast where hot keys are few.
    runs = ranked.groupBy(*keys, "_run").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(*keys, "_run", "_from", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    joined = join_small(ranked, runs, [*keys, "_run"], few)
    numbered = joined.withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_from") + 1)
    if head:
        first = numbered.where(F.col(name) == 1).select(*keys, *[c.alias(n) for n, c in head.items()])
        numbered = join_small(numbered, first, keys, few)
    return numbered.select(*df.columns, name, *head)


def join_small(df: DataFrame, small: DataFrame, keys: Sequence[str], few: bool = True) -> DataFrame:
    """Null-safe inner join with a side of unique keys, keeping one copy of the keys; broadcast where its rows are few."""
    renamed = small.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return df.join(F.broadcast(renamed) if few else renamed, same).drop(*[f"_k_{k}" for k in keys])


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    name: str = "row_no",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """The first n rows of each key, numbered. Up to GROUP_LIMIT, each task drops all but n per key before the shuffle."""
    if n > GROUP_LIMIT:
        return number_rows(df, keys, order, name, max_group_rows=max_group_rows).where(F.col(name) <= n)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    width: int,
    aggs: dict[str, Column],
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """Aggregates over each row and the ``width - 1`` rows before it within its key."""

    def frame(part, by):
        w = W.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0)
        return part.select("*", *[c.over(w).alias(n) for n, c in aggs.items()])

    hot = find_hot_keys(df, keys, max_group_rows)
    if hot is None:
        return frame(df, keys)
    cold, rest = split_hot(df, keys, hot)
    span = max(max_group_rows, width)
    at = F.col("_no") - 1
    numbered = _number_by_ranges(rest, list(keys), order, "_no", {}, hot.rows, max_group_rows, hot.few)
    numbered = numbered.withColumn("_chunk", F.floor(at / span)).withColumn("_lead", F.lit(False))
    # The last rows of a chunk are repeated ahead of the next one, where they only fill its first frames.
    lead = numbered.where(at % span >= span - (width - 1))
    lead = lead.withColumn("_chunk", F.col("_chunk") + 1).withColumn("_lead", F.lit(True))
    chunked = frame(numbered.unionByName(lead), [*keys, "_chunk"]).where(~F.col("_lead"))
    return frame(cold, keys).unionByName(chunked.select(*df.columns, *aggs))


def attach(
    df: DataFrame, keys: Sequence[str], aggs: dict[str, Column], max_group_rows: int | None = MAX_GROUP_ROWS,
    weight: Column | None = None,
) -> DataFrame:
    """Add plain aggregates over each key to its rows.

    Ordinary keys need one shuffle, which a numbering over the same keys reuses. Hot keys are pre-aggregated
    and their few results broadcast. ``weight`` counts something else than rows, say bytes.
    """

    def by_window(part):
        return part.select("*", *[c.over(W.partitionBy(*keys)).alias(n) for n, c in aggs.items()])

    hot = find_hot_keys(df, keys, max_group_rows, weight)
    if hot is None:
        return by_window(df)
    cold, rest = split_hot(df, keys, hot)
    totals = rest.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return by_window(cold).unionByName(join_small(rest, totals, list(keys), hot.few))


def lookup(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", max_group_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi join for a right side with few rows per key.

    Left rows of a hot key meet a broadcast of the hot keys' right rows, once these are counted and few. ``sizes``, of the
    left side: see ``find_hot_keys``.
    """
    keys = list(keys)
    hot = find_hot_keys(left, keys, max_group_rows, sizes=sizes)
    if hot is None:
        return left.join(right, keys, how)
    cold, rest = split_hot(left, keys, hot)
    few = right.join(hot.frame, keys, "left_semi")
    size = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0
    if size <= BROADCAST_BYTES:
        met = rest.join(F.broadcast(few), keys, how)
    else:
        salted = rest.withColumn("_salt", F.pmod(F.xxhash64(*rest.columns), F.lit(SALTS)))
        copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
        met = salted.join(copies, [*keys, "_salt"], how).drop("_salt")
    return cold.join(right, keys, how).unionByName(met)


def cut(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    size: Column,
    part_bytes: int,
    max_group_bytes: int = MAX_GROUP_BYTES,
) -> DataFrame:
    """Number the rows of each key (``_no`` from 1, ``_rows`` of them) and deal them in order to parts.

    ``part_no`` starts at 1; a part is filled with rows up to about ``part_bytes`` of ``size``, so it is over that by
    less than its last row (a number is left out after a row larger than a part). Keys of over
    ``max_group_bytes`` are numbered by runs of a range partitioning, all others by one window.
    """
    keys = list(keys)
    sized = df.withColumn("_size", F.coalesce(size.cast("bigint"), F.lit(0)) + 1)
    hot = find_hot_keys(sized, keys, max_group_bytes, F.col("_size"))
    cold = sized
    if hot is not None:
        cold, rest = split_hot(sized, keys, hot)
    placed = _places(cold, keys, order)
    if hot is not None:
        spark = df.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hot.rows // max_group_bytes))
        ranged = rest.repartitionByRange(parts, *keys, *order).withColumn("_run", F.spark_partition_id())
        ranged = materialize(ranged, "runs")
        runs = ranged.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_bytes"))
        ahead = W.partitionBy(*keys).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
        runs = runs.select(
            *keys, "_run", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n_ahead"),
            F.coalesce(F.sum("_bytes").over(ahead), F.lit(0)).alias("_bytes_ahead"),
            F.sum("_n").over(W.partitionBy(*keys)).alias("_all"),
        )
        # A run of a key is what one range partition holds of it; at most (partitions + hot keys) runs.
        inner = join_small(_places(ranged, [*keys, "_run"], order), runs, [*keys, "_run"], hot.few)
        inner = inner.withColumns(
            {"_no": F.col("_no") + F.col("_n_ahead"), "_ahead": F.col("_ahead") + F.col("_bytes_ahead"), "_rows": F.col("_all")}
        )
        placed = placed.unionByName(inner.select(*placed.columns))
    part = F.floor(F.col("_ahead") / part_bytes).cast("bigint") + 1
    return placed.withColumn("part_no", part).drop("_size", "_ahead")


def _places(df, keys, order):
    """Number of a row within its key, bytes ahead of it, and rows of the key."""
    whole = W.partitionBy(*keys)
    w = whole.orderBy(*order)
    ahead = F.sum("_size").over(w.rowsBetween(W.unboundedPreceding, -1))
    return df.withColumns(
        {
            "_no": F.row_number().over(w).cast("bigint"),
            "_ahead": F.coalesce(ahead, F.lit(0)),
            "_rows": F.count(F.lit(1)).over(whole),
        }
    )


def text_parts(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    text: str,
    part_bytes: int,
    max_group_bytes: int = MAX_GROUP_BYTES,
) -> DataFrame:
    """Lines of each key joined with newlines, in parts of about ``part_bytes``: the parts in order, joined with newlines, are
    the whole text. ``_first`` and ``_last`` tell the parts at either end."""
    numbered = cut(lines, keys, order, F.octet_length(text), part_bytes, max_group_bytes)
    grouped = numbered.groupBy(*keys, "part_no").agg(
        F.array_sort(F.collect_list(F.struct("_no", text))).alias("_lines"),
        (F.min("_no") == 1).alias("_first"),
        (F.max("_no") == F.max("_rows")).alias("_last"),
    )
    joined = F.array_join(F.transform("_lines", lambda x: x[text]), "\n")
    return grouped.select(*keys, "part_no", joined.alias(text), "_first", "_last")
