"""Blocks of candidates against blocks of queries: all exact products of a pair of blocks at once, the same answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepbank.llm import topk


def parts(m, ids, asks, bound, head=2, k=5):
    rows = np.arange(len(m))
    axes = np.linalg.eigh(m.astype(float).T @ m)[1][:, ::-1]
    block = topk._Block(rows, ids, m, axes, head)
    return topk._Queries(rows[asks], ids[asks], m[asks], np.array(bound, float), axes, head, k), block


def by_hand(m, ids, asks, bound, k=5):
    """The k best other rows of each query among those that reach its bound, in whole numbers of any size."""
    out = set()
    for q, least in zip(asks, bound, strict=True):
        scores = [(-sum(int(a) * int(b) for a, b in zip(m[q], m[j], strict=True)), ids[j], j) for j in range(len(m)) if j != q]
        out |= {(q, int(n), -s, place) for place, (s, n, _) in enumerate(sorted(scores)[:k]) if -s >= least}
    return out


def got(queries):
    f = queries.frame().sort_values(["row", "score", "vec_id"], ascending=[True, False, True])
    return set(zip(f["row"], f["vec_id"], f["score"], f.groupby("row").cumcount(), strict=True))


@pytest.mark.parametrize("few", [0, 2])
@pytest.mark.parametrize("size", [40, 2**29])
def test_block_of_pairs(monkeypatch, few, size):
    """Pair by pair and as one product, in doubles and in whole numbers that doubles don't hold; ties, copies and zeros."""
    monkeypatch.setattr(topk, "FEW", few, raising=False)
    rng = np.random.default_rng(3)
    m = rng.integers(-size, size, (200, 8))
    m[50:90], m[90:95], m[95] = m[0], 0, -m[0]
    ids = np.r_[np.arange(150), np.arange(48), topk._NO_ID, topk._NO_ID]
    asks = np.array([0, 3, 50, 90, 95, 120, 199])
    for least in (-np.inf, float((m[3].astype(float) ** 2).sum() / 2)):
        bound = [least] * len(asks)
        queries, block = parts(m, ids, asks, bound)
        assert queries.meet(block)
        assert got(queries) == by_hand(m, ids, asks, bound)


def test_only_gains_are_kept():
    """A part passes on no candidate below the bound that a query came with."""
    rng = np.random.default_rng(4)
    m = rng.integers(-50, 50, (300, 8))
    asks = np.arange(20)
    scores = m[asks] @ m.T
    scores[asks, asks] = scores.min()
    bound = np.sort(scores, axis=1)[:, -2].astype(float)
    queries, block = parts(m, np.arange(300), asks, bound)
    queries.meet(block)
    assert len(queries.frame()) == int((scores >= bound[:, None]).sum())
    assert np.array_equal(queries.bound, bound)


def test_nothing_to_gain():
    queries, block = parts(np.zeros((4, 2), np.int64), np.arange(4), np.array([1]), [1.0], head=1)
    assert not queries.meet(block) and isinstance(queries.frame(), pd.DataFrame) and not len(queries.frame())


def test_large_components(spark):
    """Products beyond 2^53, rows without a vector or an id, copies."""
    rows = [(i, [float((-1) ** i * (3_000_001 + i)), float(i * 7919 % 4_000_003)]) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1]), (100, None), (None, None), (110, [None, 1.0]), (120, [])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    good = [(i, [int(256 * x) for x in v]) for i, v in rows if v is not None and None not in v]
    wanted = []
    for at, (q, x) in enumerate(good):
        if q is not None and q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i is None, i or 0) for j, (i, y) in enumerate(good) if j != at)
            wanted += [(q, r, None if no_id else i, -s) for r, (s, no_id, i) in enumerate(scores[:5], 1)]
    assert sorted(map(str, map(tuple, topk.top_k(vectors, F.col("id") % 20 == 0).collect()))) == sorted(map(str, wanted))
