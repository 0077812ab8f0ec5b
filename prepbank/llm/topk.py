"""Exact top-k search by inner product over vectors in order of length, with partial sums on rotated axes."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepbank.operators.ordering import first_rows
from prepbank.session import materialize

K = 5
SCALE = 256
# Longest vectors that go to every task to start the queries' bounds.
PIVOTS = 1024
# Rows of a part, of a block within it, and of the queries that meet a block together.
PART_ROWS = 65_536
BLOCK = 1024
QUERY_BLOCK = 256
# Leading axes of the first partial sum, as a share of all.
HEAD = 0.25
# Share of a block's pairs below which exact products are taken pair by pair.
FEW = 0.05
# Candidates without an id come last among ties.
_NO_ID = 2**63 - 1


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (row, id, named, v, norm): floor(scale * x) of every component; rows with a null or non-finite one are left out."""
    x = F.col(vec_col)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    key = F.col(id_col).cast("bigint")
    slim = vectors.where(x.isNotNull() & whole).select(
        F.coalesce(key, F.lit(_NO_ID)).alias("id"), key.isNotNull().alias("named"), v.alias("v")
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return slim.select(F.monotonically_increasing_id().alias("row"), "id", "named", "v", F.sqrt(square).alias("norm"))


def _matrix(values: pd.Series, width: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(values), width), np.int64)
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, strongest first: from the sum of x x^T, whose size is the dimension squared."""

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch["v"], width).astype(float)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(width), "r": list(total)})

    summed = vectors.select("v").mapInPandas(gram, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "x"))
    rows = summed.groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    whole = np.zeros((width, width))
    whole[rows["i"], rows["j"]] = rows["x"]
    return np.linalg.eigh((whole + whole.T) / 2)[1][:, ::-1]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of equal values."""
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    return (np.r_[0, cuts], np.r_[cuts, len(sorted_)]) if len(sorted_) else (cuts, cuts)


class _Block:
    """Candidates of about one length. ``lead``: their leading axes, and the lengths of their rests as one axis more."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, m: np.ndarray, axes: np.ndarray, head: int):
        self.rows, self.ids, self.m = rows, ids, m
        self.lead = _lead(m, axes, head)
        self.most = np.sqrt((m.astype(float) ** 2).sum(axis=1)).max(initial=0)


def _lead(m: np.ndarray, axes: np.ndarray, head: int) -> np.ndarray:
    turned = m.astype(float) @ axes
    return np.column_stack([turned[:, :head], np.sqrt((turned[:, head:] ** 2).sum(axis=1))])


class _Queries:
    def __init__(self, rows, ids, m, bound, axes, head, k):
        self.rows, self.ids, self.m, self.bound, self.k = rows, ids, m, bound, k
        self.lead = _lead(m, axes, head)
        self.norm = np.sqrt((m.astype(float) ** 2).sum(axis=1))
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)

    def meet(self, block: _Block) -> bool:
        """Take a block in; False if no query can gain from it or from any block of shorter vectors.

        A score is a partial sum over the leading axes and a rest that is at most the product of the rests' lengths
        (Cauchy and Schwarz). Scores are whole numbers, so a bound more than half below the k-th best rules a
        candidate out for certain.
        """
        open_ = np.flatnonzero(self.norm * block.most >= self.bound - 0.5)
        if not len(open_):
            return False
        slack = 1e-9 * self.norm[open_] * block.most
        hits = self.lead[open_] @ block.lead.T >= (self.bound[open_] - 0.5 - slack)[:, None]
        at, of, scores = self._gains(open_, block, hits)
        for lo, hi in zip(*_runs(at), strict=True):
            i = open_[at[lo]]
            s, n = np.concatenate([self.found[i][0], scores[lo:hi]]), np.concatenate([self.found[i][1], block.ids[of[lo:hi]]])
            keep = _best(s, n, self.k)
            self.found[i] = (s[keep], n[keep])
            if len(keep) == self.k:
                self.bound[i] = max(self.bound[i], s[keep[-1]])
        return True

    def _gains(self, open_: np.ndarray, block: _Block, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (place in ``open_``, place in the block, score) of those in ``hits`` whose score reaches the query's bound."""
        # No sum of products exceeds the product of the lengths, so below 2^53 doubles hold all of them exactly.
        kind = float if self.norm[open_].max() * block.most < 2.0**53 else np.int64
        m, q = block.m.astype(kind, copy=False), self.m[open_].astype(kind, copy=False)
        if np.count_nonzero(hits) < FEW * hits.size:
            at, of = np.nonzero(hits)
            scores = np.einsum("ij,ij->i", q[at], m[of])
        else:
            # One matrix product costs less than the pairs one by one.
            scores = q @ m.T
            at, of = np.nonzero(hits & (scores >= self.bound[open_][:, None]))
            scores = scores[at, of]
        good = (scores >= self.bound[open_[at]]) & (block.rows[of] != self.rows[open_[at]])
        return at[good], of[good], scores[good].astype(np.int64)

    def frame(self) -> pd.DataFrame:
        sizes = [len(s) for s, _ in self.found]
        return pd.DataFrame({
            "row": np.repeat(self.rows, sizes), "query_id": np.repeat(self.ids, sizes),
            "vec_id": np.concatenate([n for _, n in self.found]), "score": np.concatenate([s for s, _ in self.found]),
        })


def top_k(
    vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", part_rows: int = PART_ROWS,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query row its k highest inner products with all other rows.

    ``is_query`` is a boolean column over ``id``. Vectors are sorted by descending length into parts over range
    partitions. The ``pivots`` longest vectors give each query a first bound; a query then goes only to the parts whose
    longest vector may still pass it, which are the first ones. In a part, blocks of candidates in order of length meet blocks of
    queries: partial sums on the leading axes of the rotation, closed by the lengths of the rests, leave few candidates for the exact
    product in whole numbers (exact while sums stay below 2^63). The k best of each part are merged. A task holds one
    part's candidates and a block of queries.

    Null vectors and those with a null or non-finite component take no part; shorter vectors count as filled up with zeros;
    rows without an id ask nothing and come last among ties; repeated rows are candidates each, also for one another;
    with fewer candidates than k there are as many rows; an empty table gives an empty result; other columns take no part.
    """
    spark = vectors.sparkSession
    whole = materialize(integer_vectors(vectors, id_col, vec_col), "vectors")
    n, width = whole.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    out = "row bigint, query_id bigint, vec_id bigint, score bigint"
    if n == 0:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(width, 1)
    head = max(1, round(HEAD * width))
    axes = rotation(whole, width)
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n // part_rows), min(n_tasks, -(-n // BLOCK)))
    ordered = whole.repartitionByRange(parts, F.desc("norm"), "row").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "by-length")
    longest = [(r["part"], r["most"]) for r in ordered.groupBy("part").agg(F.max("norm").alias("most")).orderBy("part").collect()]
    first = whole.orderBy(F.desc("norm"), "row").limit(pivots).toPandas()
    pivot = _Block(first["row"].to_numpy(), first["id"].to_numpy(), _matrix(first["v"], width), axes, head)

    def ask(rows, ids, m, bound):
        return _Queries(rows, ids, m, bound, axes, head, k)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries with a first bound, once for each part that may pass it."""
        for batch in batches:
            for at in range(0, len(batch), QUERY_BLOCK):
                some = batch.iloc[at : at + QUERY_BLOCK]
                queries = ask(some["row"].to_numpy(), some["id"].to_numpy(), _matrix(some["v"], width), np.full(len(some), -np.inf))
                queries.meet(pivot)
                goes = [[p for p, most in longest if queries.norm[i] * most >= queries.bound[i] - 0.5] for i in range(len(some))]
                yield some.assign(bound=queries.bound, goes=goes)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, blocks = None, [], []
        for batch in batches:
            cuts = np.flatnonzero(np.r_[True, np.diff(batch["part"]) != 0, True] | np.r_[True, np.diff(batch["asks"]) != 0, True])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                some = batch.iloc[lo:hi]
                if some["part"].iloc[0] != part:
                    part, rows, blocks = some["part"].iloc[0], [], []
                if not some["asks"].iloc[0]:
                    rows.append(some)
                    continue
                if rows:
                    found = pd.concat(rows).sort_values("norm", ascending=False)
                    blocks, rows = [
                        _Block(b["row"].to_numpy(), b["id"].to_numpy(), _matrix(b["v"], width), axes, head)
                        for b in (found.iloc[i : i + BLOCK] for i in range(0, len(found), BLOCK))
                    ], []
                for at in range(0, len(some), QUERY_BLOCK):
                    q = some.iloc[at : at + QUERY_BLOCK]
                    queries = ask(q["row"].to_numpy(), q["id"].to_numpy(), _matrix(q["v"], width), q["bound"].to_numpy().copy())
                    for block in blocks:
                        if not queries.meet(block):
                            break
                    yield queries.frame()

    queries = ordered.where(F.col("named") & is_query).select("row", "id", "v", "norm")
    asked = queries.mapInPandas(start, "row bigint, id bigint, v array<bigint>, norm double, bound double, goes array<int>")
    asked = asked.select("row", "id", "v", "norm", "bound", F.explode("goes").alias("part"), F.lit(1).alias("asks"))
    given = ordered.select("row", "id", "v", "norm", F.lit(0.0).alias("bound"), "part", F.lit(0).alias("asks"))
    meeting = given.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks")
    found = meeting.mapInPandas(search, out)
    best = first_rows(found, ["row"], [F.desc("score"), F.asc("vec_id")], k, "rank", None)
    vec_id = F.when(F.col("vec_id") != _NO_ID, F.col("vec_id"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), vec_id.alias("vec_id"), "score")
