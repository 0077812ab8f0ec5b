"""Search tree over bank vectors, stored once and read in part.

The vectors of a role are divided into cells around pivot vectors, cells with more than ``cell_rows`` rows again around pivots of their
own, and so on, so the number of pivots follows the bank and no node has more than ``fanout`` of them. A folder holds

- ``roots``: role, n, leaf - the rows of a role and whether it is one cell (cell 0);
- ``nodes/level=<l>``: role, node, cell, pivot, n, lo, hi, leaf - the cells of each inner node, with the smallest and largest distance
  of their rows to the pivot;
- ``blocks/part=<p>``: the vectors of the leaf cells, packed; a cell lies in one part.

A request first goes down to its nearest cells that hold k rows; the distance found there bounds the search, and it goes down
again into every cell that the triangle inequality cannot rule out. Only the parts of cells that some request opens are read.

Vectors that lie about evenly in many dimensions cannot be ruled out by cells: then nearly every request opens nearly every cell, and a row for
each of these pairs is far more than the vectors. ``opens_few`` tells beforehand; where it says no, ``all_blocks`` are scanned instead.
"""

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepbank.operators.blocks import best_rows, distances, matrix, pack, scan
from prepbank.operators.ordering import HOT_KEY_LIMIT, MAX_GROUP_ROWS, first_rows, join_small, lookup
from prepbank.session import materialize

# Vectors of a cell, and cells of a node.
CELL_ROWS = 50_000
FANOUT = 256
# Pivots for each cell_rows rows of a node: cells are of uneven sizes, and with room to spare few need another level.
ROOM = 4
# Vectors looked at for every pivot that is taken.
SAMPLED = 8
# Folders that cells are dealt to.
PARTS = 256
# Cells that a request opens at a level, on average, up to which the tree is searched, and requests that are tried for it.
OPENED = 4
TRIED = 256
# Bits of a cell's number: it grows by a factor of the fanout at every level.
CELL_BITS = 62
CELL = ["role", "cell"]


def _without(rows: DataFrame, cells: DataFrame, few: bool) -> DataFrame:
    keys = cells.select(*CELL)
    return rows.join(F.broadcast(keys) if few else keys, CELL, "left_anti")


def _pivots(rows: DataFrame, todo: DataFrame, few: bool, cell_rows: int, fanout: int) -> DataFrame:
    """Rows (role, cell, fan, pivots): up to ``fanout`` vectors of each cell that lie far apart, out of a sample of distinct ones.

    The sample are the smallest hashes, of which each task keeps its own first ones. It steers the search and does not touch its result.
    """
    size = SAMPLED * fanout
    hashed = rows.select(*CELL, F.xxhash64("v").alias("h"))
    chosen = first_rows(hashed.distinct(), CELL, [F.asc("h")], size, "_no", None).drop("_no")
    some = join_small(rows.withColumn("h", F.xxhash64("v")), chosen, [*CELL, "h"], False)
    picked = some.groupBy(*CELL, "h").agg(F.first("v").alias("v"))
    picked = join_small(picked, todo.select(*CELL, "n"), CELL, few)
    schema = T.StructType([
        rows.schema["role"], T.StructField("cell", T.LongType()), T.StructField("fan", T.IntegerType()), T.StructField("pivots", T.BinaryType())
    ])

    def apart(group: pd.DataFrame) -> pd.DataFrame:
        sample = matrix(group.sort_values("h")["v"])
        taken = _far_apart(sample, min(fanout, ROOM * -(-int(group["n"].iloc[0]) // cell_rows)))
        return pd.DataFrame({
            "role": [group["role"].iloc[0]], "cell": [group["cell"].iloc[0]], "fan": [len(taken)], "pivots": [sample[taken].tobytes()]
        })

    return picked.groupBy(*CELL).applyInPandas(apart, schema)


def _far_apart(sample: np.ndarray, fan: int) -> list[int]:
    """Up to ``fan`` different vectors of a sample: the first half as they come, so that cells share the rows; far ones alone would split off
    stragglers, level after level."""
    taken, gap = list(range(min(len(sample), max(1, fan // 2)))), np.inf
    for i in taken:
        gap = np.minimum(gap, ((sample - sample[i]) ** 2).sum(1))
    while len(taken) < fan and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[taken[-1]]) ** 2).sum(1))
    return taken


def _assign(rows: DataFrame, pivots: DataFrame, bid: str, fanout: int) -> DataFrame:
    """Rows (role, node, cell, <bid>, v, d): the cell of the nearest pivot of the node that a row was in, and its distance."""
    schema = T.StructType([
        rows.schema["role"], T.StructField("node", T.LongType()), T.StructField("cell", T.LongType()), rows.schema[bid],
        T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("d", T.DoubleType()),
    ])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for role, node, ids, vs, fan, flat in batch.itertuples(index=False):
                x = np.frombuffer(vs).reshape(len(ids), -1)
                d = distances(x, np.frombuffer(flat).reshape(fan, -1))
                at = d.argmin(1)
                yield pd.DataFrame({
                    "role": role, "node": node, "cell": node * fanout + 1 + at, bid: list(ids), "v": list(x), "d": d[np.arange(len(x)), at]
                })

    blocks = pack(rows, bid).select(*CELL, f"{bid}s", "vs")
    return blocks.join(pivots, CELL).mapInPandas(nearest, schema)


def build_tree(rows: DataFrame, path: str, bid: str, cell_rows: int = CELL_ROWS, fanout: int = FANOUT, parts: int = PARTS) -> None:
    """Store the search tree of rows ``role, <bid>, v``; give them materialized. The roots are written last: without them there is no tree.

    Each level costs a shuffle of the rows of the cells that are still too large; three levels hold ``fanout``^3 cells. A cell whose vectors are
    all equal cannot be divided, nor one whose number leaves no room for another level: it stays one cell of any size, which the scan deals
    over slots.
    """
    spark = rows.sparkSession
    roots = materialize(rows.groupBy("role").agg(F.count(F.lit(1)).alias("n")), "roots").withColumn("leaf", F.col("n") <= cell_rows)
    todo = roots.where(~F.col("leaf")).select("role", F.lit(0).cast("bigint").alias("cell"), "n")
    here = rows.withColumns({"cell": F.lit(0).cast("bigint"), "d": F.lit(0.0)}).select(*CELL, bid, "v", "d")
    leaves, level = None, 0
    deepest = max(1, int(CELL_BITS / math.log2(max(2, fanout))))
    while True:
        count = todo.count()
        few = count <= HOT_KEY_LIMIT
        done = _without(here, todo, few)
        leaves = done if leaves is None else leaves.unionByName(done)
        if not count:
            break
        inner = join_small(here, todo.select(*CELL), CELL, few)
        pivots = materialize(_pivots(inner, todo, few, cell_rows, fanout), "pivots")
        placed = materialize(_assign(inner, pivots, bid, fanout), "placed")
        cells = placed.groupBy("role", "node", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
        sizes = todo.select("role", F.col("cell").alias("node"), F.col("n").alias("all")).join(
            pivots.select("role", F.col("cell").alias("node"), "fan", "pivots"), ["role", "node"]
        )
        width = (F.length("pivots") / F.col("fan")).cast("int")
        at = (F.col("cell") - F.col("node") * fanout - 1).cast("int")
        cells = cells.join(sizes, ["role", "node"]).select(
            "role", "node", "cell", F.substr("pivots", at * width + 1, width).alias("pivot"), "n", "lo", "hi",
            ((F.col("n") <= cell_rows) | (F.col("n") == F.col("all")) | F.lit(level + 1 >= deepest)).alias("leaf"),
        )
        cells.write.mode("overwrite").parquet(_nodes(path, level))
        cells = spark.read.schema(cells.schema).parquet(_nodes(path, level))
        todo = cells.where(~F.col("leaf")).select(*CELL, "n")
        here = placed.select(*CELL, bid, "v", "d")
        level += 1
    packed = pack(leaves, bid).select("*", _part(parts).alias("part"))
    spread = packed.hint("rebalance", "part").sortWithinPartitions("part", *CELL)
    spread.write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    if roots.isEmpty():
        # a folder of no files has no columns to read
        packed.drop("part").write.mode("overwrite").parquet(f"{path}/blocks/part=0")
    about = {"levels": F.lit(level), "parts": F.lit(parts)}
    roots.withColumns(about).coalesce(1).write.mode("overwrite").parquet(f"{path}/roots")


def _nodes(path: str, level: int) -> str:
    return f"{path}/nodes/level={level}"


def _part(parts) -> F.Column:
    return F.pmod(F.xxhash64(*CELL), F.lit(parts)).cast("int")


def opened_blocks(wanted: DataFrame, path: str, parts: int) -> DataFrame:
    """The blocks in the folders of the cells that are wanted; other folders are not read. At most ``parts`` numbers come to the driver."""
    found = sorted(r[0] for r in wanted.select(_part(parts).alias("part")).distinct().collect())
    return wanted.sparkSession.read.parquet(f"{path}/blocks").where(F.col("part").isin(found))


def all_blocks(spark, path: str) -> DataFrame:
    """Every block, as of one cell for each role."""
    return spark.read.parquet(f"{path}/blocks").withColumn("cell", F.lit(0).cast("bigint"))


def _descend(start: DataFrame, path: str, levels: int, rid: str, k: int | None) -> DataFrame:
    """Rows (role, cell, <rid>, v, bound, leaf) of the leaf cells that requests open: with ``k`` the nearest ones of each node that hold k
    rows, else those that may hold a row within ``bound``."""
    here = start.select(*CELL, rid, "v", "bound", "leaf")
    done = here.where("leaf")
    for level in range(levels):
        here = _opened(here, path, level, rid, k)
        done = done.unionByName(here.where("leaf"))
    return done


def _opened(here: DataFrame, path: str, level: int, rid: str, k: int | None) -> DataFrame:
    """The cells of one level that requests open out of the inner cells that they are ``here`` at.

    Requests are packed by the node they are at and meet its cells there, so a request carries its id, vector and bound alone; a task
    sees each node's cells once for a block of requests.
    """
    spark = here.sparkSession
    schema = T.StructType([
        here.schema["role"], T.StructField("cell", T.LongType()), here.schema[rid], T.StructField("v", T.ArrayType(T.DoubleType())),
        T.StructField("bound", T.DoubleType()), T.StructField("leaf", T.BooleanType()),
    ])

    def open_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for role, ids, vs, cells in batch.itertuples(index=False):
                q = np.frombuffer(vs).reshape(len(ids), -1)
                q, bound = q[:, :-1], q[:, -1]
                d = distances(q, np.stack([np.frombuffer(c["pivot"]) for c in cells]))
                if k is None:
                    low, high = (np.array([c[x] for c in cells]) for x in ("lo", "hi"))
                    taken = _within(d, low, high, bound)
                else:
                    by = np.argsort(d, axis=1, kind="stable")
                    ahead = np.cumsum(np.array([c["n"] for c in cells])[by], axis=1)
                    few = (ahead < k).sum(1) + 1
                    taken = np.argsort(by, axis=1, kind="stable") < few[:, None]
                qi, ci = np.nonzero(taken)
                if not len(qi):
                    continue
                yield pd.DataFrame({
                    "role": role, "cell": np.array([c["cell"] for c in cells])[ci], rid: [ids[i] for i in qi], "v": list(q[qi]),
                    "bound": bound[qi], "leaf": np.array([c["leaf"] for c in cells], bool)[ci],
                })

    inner = here.where(~F.col("leaf")).select(*CELL, rid, F.concat("v", F.array("bound")).alias("v"), F.lit(0.0).alias("d"))
    cell = F.struct("cell", "pivot", "n", "lo", "hi", "leaf")
    nodes = spark.read.parquet(_nodes(path, level)).groupBy("role", F.col("node").alias("at")).agg(F.collect_list(cell).alias("cells")).withColumnRenamed("at", "cell")
    blocks = pack(inner, rid, gather=level > 0).select(*CELL, f"{rid}s", "vs")
    met = blocks.join(nodes, CELL).select("role", f"{rid}s", "vs", "cells")
    return materialize(met.mapInPandas(open_cells, schema), "opened")


def may_open_few(
    asked: DataFrame, blocks: DataFrame, nearest: Callable[[DataFrame], DataFrame], k: int, rid: str, cell_rows: int, fanout: int,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> bool:
    """Whether a tree over ``blocks``, one cell for each role, is worth building: what ``opens_few`` says of it, told from a sample.

    Some requests, with the distance of the k-th row that ``nearest`` finds for them, meet first cells around pivots out of some blocks. Their
    reaches are those of the sample, so the tree opens more cells than are counted here. Rows are the same either way.
    """
    each = blocks.groupBy("role").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("of")).where(F.col("n") > cell_rows)
    large = materialize(each.withColumn("fan", F.least(F.lit(fanout), ROOM * F.ceil(F.col("n") / cell_rows)).cast("int")), "large")
    counts = asked.groupBy("role").agg(F.count(F.lit(1)).alias("asked")).join(large, "role")
    pairs, total = counts.agg(F.sum(F.col("asked") * F.col("fan")), F.sum("n")).head()
    if pairs is None:
        return False
    if pairs <= total:
        return True
    start = _start(asked, large.withColumn("leaf", F.lit(False)), rid, max_group_rows).orderBy(F.xxhash64("role", "v"), rid).limit(TRIED)
    start = materialize(start.select("role", rid, "v"), "tried")
    bounds = nearest(start).groupBy(rid).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_bound"))
    bounds = materialize(bounds, "bounds")
    tried = start.join(bounds, rid, "left").select("role", "v", F.coalesce("_bound", F.lit(float("inf"))).alias("bound"))
    # as many blocks, about, as hold twice the sample that pivots are taken from
    wanted = F.ceil(2 * SAMPLED * fanout * F.col("of") / F.col("n"))
    some = blocks.select("role", "vs", F.col("n").alias("rows")).join(large.join(start.select("role").distinct(), "role", "left_semi"), "role")
    some = some.where(F.pmod(F.xxhash64("vs"), F.col("of")) < wanted).select("role", "vs", "rows", "fan")

    def opened(tried: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        count = None
        if len(tried) and len(held):
            held = held.sort_values("vs")
            x = np.concatenate([np.frombuffer(v) for v in held["vs"]]).reshape(int(held["rows"].sum()), -1)
            pivots = x[_far_apart(x, int(held["fan"].iloc[0]))]
            to = distances(x, pivots)
            at, to = to.argmin(1), to.min(1)
            low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
            np.minimum.at(low, at, to)
            np.maximum.at(high, at, to)
            count = int(_within(distances(matrix(tried["v"]), pivots), low, high, tried["bound"].to_numpy()).sum())
        return pd.DataFrame({"tried": [len(tried)], "opened": pd.array([count], "Int64")})

    met = tried.groupBy("role").cogroup(some.groupBy("role")).applyInPandas(opened, "tried bigint, opened bigint")
    seen, known, count = met.agg(F.sum(F.when(F.col("opened").isNotNull(), F.col("tried"))), F.count("opened"), F.sum("opened")).head()
    return not known or count <= OPENED * seen


def _within(d: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Which cells may hold a row within the bound of a request, by its distances from the pivots."""
    reach = np.sqrt(bound)
    reach = reach + 1e-6 * (1.0 + reach)
    return np.maximum(d - high, low - d) <= reach[:, None]


def _start(asked: DataFrame, roots: DataFrame, rid: str, max_group_rows: int | None) -> DataFrame:
    start = lookup(asked, roots.select("role", "leaf"), ["role"], "inner", max_group_rows)
    return start.select("role", F.lit(0).cast("bigint").alias("cell"), rid, "v", F.lit(float("inf")).alias("bound"), "leaf")


def _first_pass(start: DataFrame, path: str, levels: int, k: int, rid: str, bid: str, parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nearest cells of requests, the nearest rows in these, and the requests that go down again, with their bounds."""
    first = materialize(_descend(start, path, levels, rid, k), "first-cells")
    near = materialize(best_rows(_found(first, path, parts, rid, bid, k), rid, bid, k).drop("rank"), "nearest")
    bounds = near.groupBy(rid).agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("_bound"))
    # A role that is one cell has been seen whole.
    again = start.where(~F.col("leaf")).join(bounds, rid, "left").withColumn("bound", F.coalesce("_bound", "bound")).drop("_bound")
    return first, near, again


def _found(wanted: DataFrame, path: str, parts: int, rid: str, bid: str, k: int) -> DataFrame:
    rows = wanted.select(*CELL, rid, "v", F.lit(0.0).alias("d"))
    return scan(rows, opened_blocks(wanted, path, parts), rid, bid, k)


def _about(path: str, spark) -> tuple[DataFrame, int, int, int]:
    """The roots, and the rows, levels and folders of a stored tree."""
    roots = spark.read.parquet(f"{path}/roots")
    total, levels, parts = roots.agg(F.sum("n"), F.max("levels"), F.max("parts")).head()
    return roots, total or 0, levels or 0, parts or 1


def opens_few(asked: DataFrame, path: str, k: int, rid: str, bid: str, max_group_rows: int | None = MAX_GROUP_ROWS) -> bool:
    """Whether a search of the tree moves few rows: because there are few requests and cells, or by the cells that some requests open.

    Requests with the smallest hashes are tried, level by level, and no further than they open few. Rows are the same either way.
    """
    spark = asked.sparkSession
    roots, total, levels, parts = _about(path, spark)
    if not levels:
        return True
    cells = spark.read.parquet(f"{path}/nodes").groupBy("role").agg(F.count(F.lit(1)).alias("cells"))
    pairs = asked.groupBy("role").agg(F.count(F.lit(1)).alias("asked")).join(cells, "role").agg(F.sum(F.col("asked") * F.col("cells"))).head()[0]
    if (pairs or 0) <= total:
        return True
    k = min(k, max(1, total))
    start = _start(asked, roots.where(~F.col("leaf")), rid, max_group_rows).orderBy(F.xxhash64("role", "v"), rid).limit(TRIED)
    start = materialize(start, "tried")
    tried, (_, _, here) = start.count(), _first_pass(start, path, levels, k, rid, bid, parts)
    for level in range(levels):
        here = _opened(here, path, level, rid, None)
        if here.count() > OPENED * tried:
            return False
    return True


def search_tree(
    asked: DataFrame, path: str, k: int, rid: str, bid: str, max_group_rows: int | None = MAX_GROUP_ROWS
) -> DataFrame:
    """The k nearest rows (``<rid>, <bid>, distance, rank``) of a stored tree for requests ``role, <rid>, v``; k is clamped by its rows."""
    roots, total, levels, parts = _about(path, asked.sparkSession)
    k = min(k, max(1, total))
    start = _start(asked, roots, rid, max_group_rows)
    if not levels:
        return best_rows(_found(materialize(start, "start"), path, parts, rid, bid, k), rid, bid, k)
    first, near, again = _first_pass(start, path, levels, k, rid, bid, parts)
    more = _descend(again, path, levels, rid, None)
    more = materialize(more.join(first.select(rid, "cell"), [rid, "cell"], "left_anti"), "more-cells")
    return best_rows(near.unionByName(_found(more, path, parts, rid, bid, k)), rid, bid, k)
