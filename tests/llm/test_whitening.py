"""Whitening against a dense eigensolver over exact whole numbers."""

import collections
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepbank.llm import registered, whitening


def matrix(values, seed=5):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [3.0, 1.0], [1e9, 1e3, 1.0, 1e-3], [2.0, 2.0, 2.0, 2.0], [4.0, 4.0, 4.0, 1.0, 1.0], [7.0, 0.0, 0.0, 0.0, 0.0],
        [0.0, 0.0], [1 + 1e-9, 1.0, 1 - 1e-9, 0.5], list(np.geomspace(1e6, 1e-6, 40)), list(np.linspace(1, 2, 90)),
    ],
)
def test_components(values):
    a = matrix(values)
    k = min(4, len(values))
    found, axes = whitening.leading_components(a, k)
    top = max(max(values), 1e-300)
    assert found == pytest.approx(sorted(values, reverse=True)[:k], rel=1e-12, abs=1e-12 * top)
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13
    assert np.linalg.norm(a @ axes - axes * found) < 1e-12 * max(np.linalg.norm(a), 1e-300)


def test_polar_factor():
    for values in ([3, -1, 1e-7, -2], [1, 1, -1], [1e8, -1e-6, 5]):
        u = whitening.polar(matrix(np.array(values, float)))
        assert np.abs(u @ u - np.eye(len(values))).max() < 1e-12
        assert np.trace(u) == pytest.approx(sum(np.sign(values)))


def by_hand(rows):
    """[(id, deviation, projections up to sign)] and the shares, from exact whole numbers."""
    x = [[math.floor(256 * np.float64(np.float32(c))) for c in v] for _, v in rows]
    width = max(map(len, x), default=0)
    x = [v + [0] * (width - len(v)) for v in x]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    out = []
    for (key, _), row in zip(rows, x, strict=True):
        off = [n * c - s for c, s in zip(row, sums, strict=True)]
        out.append((key, sum(o * o for o in off), np.array([o / n for o in off]) @ axes / np.sqrt(values)))
    return n, out, values / np.trace(v)


def test_whitening_by_hand(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=7) * np.arange(1, 8) + 0.1).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(0, rows[5][1]), (None, rows[6][1]), (2**60 + 1, [1.0, 2.0])]
    bad = [(1, None), (2, [1.0, None] + [0.0] * 5), (3, [float("nan")] * 7), (4, [float("-inf")] * 7), (None, None)]
    vectors = spark.createDataFrame([(*r, "x", 1, 2) for r in rows + bad], "vec_id bigint, embedding array<float>, id string, x int, n int")
    got = whitening.whiten(vectors.repartition(5)).collect()
    n, wanted, shares = by_hand(rows)
    assert len(got) == 4 * len(rows)
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert collections.Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == collections.Counter(
        (k, d) for k, d, _ in wanted
    )
    by_key = collections.defaultdict(dict)
    for r in got:
        by_key[r["vec_id"], r["deviation"]][r["component"]] = r["whitened"]
        assert r["explained"] == pytest.approx(shares[r["component"] - 1], rel=1e-9)
    signs = np.sign([by_key[1, wanted[1][1]][c] for c in range(1, 5)]) * np.sign(wanted[1][2])
    for key, deviation, white in wanted:
        assert [by_key[key, deviation][c] for c in range(1, 5)] == pytest.approx(signs * white, abs=1e-9)


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], schema)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(1, 0, 0.0, 0.0, 0.0)}
    assert len(same) == 4
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [2.0**40, -3.0])], schema)
    rows = whitening.whiten(huge).collect()
    assert len(rows) == 6 and {r["deviation"] for r in rows} == {None} and all(math.isfinite(r["whitened"]) for r in rows)
    wide = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], schema)
    flat = whitening.whiten(wide).collect()
    # One direction holds all variance; the others are without any.
    assert {r["whitened"] for r in flat if r["component"] > 1} == {0.0} and flat[0]["identity_error"] < 1e-9


def test_registered_query(spark, data):
    got = registered.QUERIES["op11_whiten_embeddings"](spark, data)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert "Window" not in got._jdf.queryExecution().toString()
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    n, wanted, shares = by_hand(rows)
    found = got.collect()
    assert {r["n"] for r in found} == {n} and found[0]["identity_error"] <= 1e-6
    assert {(r["vec_id"], r["deviation"]) for r in found} == {(k, d) for k, d, _ in wanted}
    first = {r["vec_id"]: r["whitened"] for r in found if r["component"] == 1}
    sign = np.sign(first[rows[0][0]]) * np.sign(wanted[0][2][0])
    assert [first[k] for k, _, _ in wanted] == pytest.approx([sign * w[0] for _, _, w in wanted], abs=1e-8)
    assert got.where(F.col("whitened").isNull()).count() == 0
