"""Blocks of vectors: packed rows of one role and cell, and the scan that meets them without making pairs into rows.

Bank vectors and request vectors are packed, per role and cell, into rows of at most BLOCK_ROWS vectors. Either side of a (role,
cell) is dealt over slots of bounded size; a slot of requests meets a slot of the bank in one group, which passes on only the k best per
request. So a task holds two slots, whatever the size of the bank, and a vector is sent once for every slot of the other side.
"""

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.operators.ordering import find_hot_keys, first_rows

BLOCK_ROWS = 512
# Vectors, and values of them, that one group takes from either side of the scan; fewer where that leaves cores without a group.
SLOT_ROWS = 256 * BLOCK_ROWS
SLOT_VALUES = 8 << 20
GROUPS_PER_CORE = 8
# Most partitions that groups are dealt to.
MAX_PARTS = 100_000
# Requests and bank vectors of one matrix product, and bank vectors of the first, which gives the bounds of the others.
TILE = 512
TILE_BANK = 512
FIRST = 1024
# The first one takes a part of the bank that grows with it, so that few rows of the rest are within the bounds.
FIRST_PART = 8
# Candidates that wait for their distances, in multiples of those that are taken at once.
WAITING = 8
# Values of candidate vectors taken at once.
DIRECT_VALUES = 4 << 20
# Largest square of a length that is left to single precision.
SINGLE = 1e30


def matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def pack(df: DataFrame, key: str, gather: bool = True) -> DataFrame:
    """Rows ``role, cell, <key>, v, d`` packed into blocks of one role and cell.

    ``gather`` brings rows of a role and cell together first; without it each task packs the rows it has.
    """
    schema = T.StructType(
        [
            df.schema["role"],
            T.StructField("cell", df.schema["cell"].dataType),
            T.StructField("block", T.StringType()),
            T.StructField("n", T.IntegerType()),
            T.StructField(f"{key}s", T.ArrayType(df.schema[key].dataType)),
            T.StructField("vs", T.BinaryType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("hi", T.DoubleType()),
        ]
    )

    rows = BLOCK_ROWS

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for (role, cell), group in batch.groupby(["role", "cell"], sort=False):
                for at in range(0, len(group), rows):
                    part = group.iloc[at : at + rows]
                    made.append(
                        {
                            "role": role,
                            "cell": cell,
                            "block": uuid.uuid4().hex,
                            "n": len(part),
                            f"{key}s": part[key].tolist(),
                            "vs": matrix(part["v"]).tobytes(),
                            "lo": part["d"].min(),
                            "hi": part["d"].max(),
                        }
                    )
            if made:
                yield pd.DataFrame(made, columns=schema.fieldNames())

    # rebalance lets Spark split the partition of a hot role or cell at run time
    placed = df.hint("rebalance", "role", "cell").sortWithinPartitions("role", "cell") if gather else df
    return placed.mapInPandas(blocks, schema)


def scan(wanted: DataFrame, blocks: DataFrame, rid: str, bid: str, k: int, gather: bool = True) -> DataFrame:
    """Rows that may be among the k nearest of a request, out of the blocks of the cells it wants.

    A bank vector has one id, or a sorted list of those of its copies. ``gather`` packs requests of many cells; requests of few are
    packed where they are.
    """
    ids = blocks.schema[f"{bid}s"].dataType.elementType
    copied = isinstance(ids, T.ArrayType)
    schema = T.StructType(
        [
            T.StructField(rid, wanted.schema[rid].dataType),
            T.StructField(bid, ids.elementType if copied else ids),
            T.StructField("distance", T.DoubleType()),
        ]
    )

    def nearest(asked: pa.Table, bank: pa.Table) -> pa.Table:
        q_ids, own = pc.list_flatten(asked["ids"]).combine_chunks(), pc.list_flatten(bank["ids"]).combine_chunks()
        ids, copies = own.flatten(), pc.list_value_length(own).to_numpy()
        qi, at, dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(q_ids) and len(ids):
            qi, at, dist = nearest_rows(_vectors(asked, len(q_ids)), _vectors(bank, len(own)), copies, ids, k)
        return pa.table({rid: q_ids.take(pa.array(qi)), bid: ids.take(pa.array(at)), "distance": dist})

    left = pack(wanted, rid, gather).select("role", "cell", F.col(f"{rid}s").alias("ids"), "vs")
    listed = F.col(f"{bid}s") if copied else F.transform(f"{bid}s", lambda x: F.array(x))
    right = blocks.select("role", "cell", listed.alias("ids"), "vs")
    slot, parts = _slot_rows(wanted, blocks)
    many_q = find_hot_keys(wanted, ["role", "cell"], slot)
    many_b = find_hot_keys(blocks, ["role", "cell"], slot, F.col("n"))
    left = _deal(left, slot, many_q, "q_slot", many_b, "b_slot")
    right = _deal(right, slot, many_b, "b_slot", many_q, "q_slot")
    keys = ["role", "cell", "q_slot", "b_slot"]
    if parts:
        # small in bytes and long to work on: Spark would put them together by their bytes
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, schema)


def _vectors(blocks: pa.Table, n: int) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer()) for x in blocks["vs"]]).reshape(n, -1)


def _slot_rows(wanted: DataFrame, blocks: DataFrame) -> tuple[int, int]:
    """Vectors of a slot: as many as a task may hold, or fewer, so that the pairs of slots keep all cores at work. And the partitions that these
    pairs are dealt to, where there is work for more than Spark would make."""
    asked = wanted.groupBy("role", "cell").agg(F.count(F.lit(1)).alias("q"), F.max(F.size("v")).alias("dims"))
    bank = blocks.groupBy("role", "cell").agg(F.sum("n").alias("b"))
    pairs = F.sum(F.col("q").cast("double") * F.col("b"))
    pairs, dims = asked.join(bank, ["role", "cell"]).agg(pairs, F.max("dims")).head()
    cores = wanted.sparkSession.sparkContext.defaultParallelism
    even = max(4 * BLOCK_ROWS, math.isqrt(int((pairs or 0) / (GROUPS_PER_CORE * cores))))
    slot = max(1, min(SLOT_ROWS, even, SLOT_VALUES // max(1, dims or 1)))
    groups = int((pairs or 0) / slot**2)
    return slot, min(MAX_PARTS, 2 * groups) if groups > cores else 0


def _deal(df, slot, own, own_slot, other, other_slot):
    """Deal the blocks of a hot cell over slots, and repeat them for every slot of the other side.

    Each pair of blocks still meets once, but no task holds more than a slot of either side.
    """

    def slots(df, hot, name):
        if hot is None:
            return df.withColumn(name, F.lit(1))
        some = hot.sized.select("role", "cell", F.ceil(F.col("_rows") / slot).cast("int").alias(name))
        return df.join(some, ["role", "cell"], "left").withColumn(name, F.coalesce(name, F.lit(1)))

    df = slots(slots(df, own, "_own"), other, "_other")
    df = df.withColumn(own_slot, F.pmod(F.xxhash64("ids"), F.col("_own")).cast("int"))
    return df.withColumn(other_slot, F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).drop("_own", "_other")


def nearest_rows(q: np.ndarray, x: np.ndarray, copies: np.ndarray, ids: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of requests and of ids, and distances, of the k nearest rows of every request; ``copies`` of the ids belong to a vector.

    A matrix product gives a lower bound of every distance, rounding allowed for. Only where it is within the k-th distance
    found so far is the distance taken directly.
    """
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(pa.table({"id": ids}), [("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(ids))
    start = np.cumsum(copies) - copies
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    kind = np.float32 if max(qq.max(), xx.max()) < SINGLE else np.float64
    off = 2 * (q.shape[1] + 8) * float(np.finfo(kind).eps) / 2
    left = np.column_stack([-2 * q, np.ones(len(q)), qq * (1 - off)]).astype(kind)
    right = np.column_stack([x, xx * (1 - off), np.ones(len(x))]).astype(kind)
    step = max(1, DIRECT_VALUES // q.shape[1])
    found = []
    first = min(len(x), max(FIRST, len(x) // FIRST_PART))
    for low in range(0, len(q), TILE):
        mine, own = left[low : low + TILE], qq[low : low + TILE]
        bound = np.full(len(mine), np.inf)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        waiting, waits = [], 0
        edges = [0, *range(first, len(x), TILE_BANK), len(x)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            lower = mine @ right[a:b].T
            if not a and b >= k:
                reach = np.partition(lower, k - 1, axis=1)[:, k - 1].astype(float) + 4 * off * (own + xx[a:b].max())
                bound = np.where(np.isnan(reach), np.inf, reach)
            hits = _few_true((lower <= (bound * (1 + 1e-6) + 1e-30)[:, None].astype(kind)).ravel())
            for at in range(0, len(hits), step):
                some = hits[at : at + step]
                qi, xi = np.divmod(some, b - a)
                waiting.append((qi, xi + a, lower.ravel()[some]))
                waits += len(qi)
                if waits > WAITING * step:
                    best, bound = _settled(best, waiting, bound, q[low : low + TILE], x, own, xx, off, rank[start], k)
                    waiting, waits = [], 0
        (qi, xi, dist), _ = _settled(best, waiting, bound, q[low : low + TILE], x, own, xx, off, rank[start], k)
        # each vector brings its ids
        n = np.minimum(copies[xi], k)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        qi, ii, dist = _first_of([(np.repeat(qi, n), np.repeat(start[xi], n) + nth, np.repeat(dist, n))], rank, k)
        found.append((qi + low, ii, dist))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _few_true(flags):
    """Positions of the true ones, of which there are few: looked for eight at a time."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    eights = np.flatnonzero(flags.view(np.uint64) != 0)
    at, nth = np.nonzero(flags.reshape(-1, 8)[eights])
    return eights[at] * 8 + nth


def _settled(best, waiting, bound, q, x, qq, xx, off, rank, k):
    """The first k rows of every request out of ``best`` and the rows (request, position, lower bound) that wait, and the bounds after them.

    The k-th of the upper bounds of the rows that wait rules out most of them before any distance is taken.
    """
    if waiting:
        qi, xi, lower = (np.concatenate(part) for part in zip(*waiting, strict=True))
        upper = lower + 4 * off * (qq[qi] + xx[xi])
        kth = _kth_upper(qi, upper, len(qq), k)
        near = np.flatnonzero(~(lower > (np.minimum(bound, kth) * (1 + 1e-6) + 1e-30)[qi]))
        step = max(1, DIRECT_VALUES // q.shape[1])
        for at in range(0, len(near), step):
            qj, xj = qi[near[at : at + step]], xi[near[at : at + step]]
            best = _first_of([best, (qj, xj, ((q[qj] - x[xj]) ** 2).sum(1))], rank, k)
    return best, _kth(best, bound, k)


def _kth_upper(qi, upper, n, k):
    """The k-th smallest value of each of n requests; infinite where there are fewer, or where they cannot be told."""
    kth = np.full(n, np.inf)
    if not np.isfinite(upper).all():
        return kth
    # one number for request and value: requests lie further apart than their values
    least = upper.min()
    apart = 2 * (upper.max() - least) + 1e-30
    by = np.sort(qi * apart + (upper - least))
    ends = np.cumsum(np.bincount(qi, minlength=n))
    starts = ends - np.bincount(qi, minlength=n)
    full = np.flatnonzero(ends - starts >= k)
    # what the sum may have lost is added
    kth[full] = by[starts[full] + k - 1] - full * apart + least + 4 * n * apart * np.finfo(float).eps
    return kth


def _first_of(parts, rank, k):
    """The first k rows (request, position, distance) of every request, in order of distance and rank."""
    qi, xi, dist = (np.concatenate(part) for part in zip(*parts, strict=True))
    order = np.lexsort((rank[xi], dist, qi))
    qi, xi, dist = qi[order], xi[order], dist[order]
    first = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[first], xi[first], dist[first]


def _kth(best, bound, k):
    """The bounds, lowered to the k-th distance of the requests that have k rows."""
    qi, _, dist = best
    last = np.flatnonzero(np.arange(len(qi)) - np.searchsorted(qi, qi) == k - 1)
    lowered = bound.copy()
    lowered[qi[last]] = np.minimum(bound[qi[last]], dist[last])
    return lowered


def best_rows(found: DataFrame, rid: str, bid: str, k: int) -> DataFrame:
    return first_rows(found, [rid], [F.asc("distance"), F.asc(bid)], k, "rank")


def distances(q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (q * q).sum(1)[:, None] - 2.0 * (q @ pivots.T) + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))
