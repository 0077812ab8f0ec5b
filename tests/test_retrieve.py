"""Top-k against brute force, with equal vectors, ties, hot roles and cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepbank.operators import blocks, tree
from prepbank.operators import retrieve as r
from prepbank.session import fresh_path, materialize


def brute(requests, bank, k, metric="l2"):
    """{request: [(id, distance)]} by a full scan."""
    out = {}
    for rid, role, q in requests:
        found = []
        for bid, b_role, v in bank:
            if b_role == role:
                x, y = np.array(q, float), np.array(v, float)
                if metric == "cosine":
                    d = 1 - (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y))
                else:
                    d = float(((x - y) ** 2).sum())
                found.append((round(d, 6), bid))
        out[rid] = [(bid, d) for d, bid in sorted(found)[:k]]
    return {rid: x for rid, x in out.items() if x}


@pytest.fixture(scope="module")
def vectors():
    """Clustered vectors on a grid, so distances tie; a third of the bank is one copied vector of one role."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (12, 6))

    def some(n):
        return (centres[rng.integers(0, 12, n)] + rng.integers(-2, 3, (n, 6))).astype(float)

    bank = [(i, f"r{i % 3}" if i % 2 else "r0", v.tolist()) for i, v in enumerate(some(400))]
    copy = bank[0][2]
    bank += [(400 + i, "r0", copy) for i in range(200)]
    requests = [(i, ["r0", "r1", "r2", "none"][i % 4], v.tolist()) for i, v in enumerate(some(60))]
    requests.append((60, "r0", copy))
    return requests, bank


def frames(spark, vectors, kind="double"):
    requests, bank = vectors
    return (
        spark.createDataFrame(requests, f"session_id bigint, role string, embedding array<{kind}>"),
        spark.createDataFrame(bank, f"id bigint, role string, embedding array<{kind}>"),
    )


def collected(near):
    out = {}
    for row in sorted(near.collect(), key=lambda x: (x["session_id"], x["rank"])):
        out.setdefault(row["session_id"], []).append((row["id"], round(row["distance"], 6)))
    return out


@pytest.mark.parametrize("cell_rows, k", [(tree.CELL_ROWS, 1), (tree.CELL_ROWS, 20), (tree.CELL_ROWS, 250), (40, 1), (150, 250)])
def test_knn_is_exact(spark, vectors, cell_rows, k):
    got = collected(r.knn(*frames(spark, vectors), k, cell_rows=cell_rows))
    assert got == brute(*vectors, k)


def test_knn_with_hot_request_roles(spark, vectors):
    got = collected(r.knn(*frames(spark, vectors, "float"), 20, cell_rows=40, max_group_rows=5))
    assert got == brute(*vectors, 20)


def test_knn_with_cells_hot_on_both_sides(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    monkeypatch.setattr(blocks, "SLOT_ROWS", 10)
    for k in (3, 20):
        assert collected(r.knn(*frames(spark, vectors), k, cell_rows=150)) == brute(*vectors, k)


def test_knn_beyond_the_broadcast_size(spark, vectors, monkeypatch):
    monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "SLOT_ROWS", 50)
    assert collected(r.knn(*frames(spark, vectors), 20)) == brute(*vectors, 20)


@pytest.mark.parametrize("plan", ["broadcast", "joined", "cells"])
def test_equal_request_vectors(spark, monkeypatch, plan):
    """One vector asked by requests of several blocks, and in two roles."""
    rng = np.random.default_rng(3)
    rows = rng.integers(-30, 30, (200, 4)).astype(float).tolist()
    bank = [(i, f"r{i % 2}", v) for i, v in enumerate(rows)]
    requests = [(i, f"r{i // 60 % 2}", rows[0]) for i in range(120)] + [(120 + i, "r0", rows[i % 3]) for i in range(30)]
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    if plan != "broadcast":
        monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
    options = {"cell_rows": 30} if plan == "cells" else {}
    assert collected(r.knn(*frames(spark, (requests, bank)), 20, **options)) == brute(requests, bank, 20)


def test_string_ids(spark, vectors):
    requests, bank = vectors
    bank = [(f"q_{i}", role, v) for i, role, v in bank]
    asked, _ = frames(spark, vectors)
    rows = spark.createDataFrame(bank, "id string, role string, embedding array<double>")
    assert collected(r.knn(asked, rows, 20)) == brute(requests, bank, 20)


def test_cosine(spark, vectors):
    got = collected(r.knn(*frames(spark, vectors), 20, metric="cosine", cell_rows=40))
    wanted = brute(*vectors, 20, "cosine")
    assert got.keys() == wanted.keys()
    for rid, rows in wanted.items():
        assert [d for _, d in got[rid]] == pytest.approx([d for _, d in rows], abs=2e-6)


def test_ranks_are_dense_and_blocks_are_cut(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    near = r.knn(*frames(spark, vectors), 20)
    assert collected(near) == brute(*vectors, 20)
    ranks = near.groupBy("session_id").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert all(row["ranks"] == list(range(1, len(row["ranks"]) + 1)) for row in ranks)


def test_empty_bank(spark, vectors):
    requests, bank = frames(spark, vectors)
    assert r.knn(requests, bank.where("id < 0"), 20).count() == 0


@pytest.mark.parametrize("cell_rows, fanout", [(16, 4), (5, 40)])
def test_tree_of_several_levels(spark, vectors, cell_rows, fanout):
    """Cells of bounded size at any depth, but for one of equal vectors, and every row in one of them; the same rows as by a full scan."""
    requests, bank = frames(spark, vectors)
    path = fresh_path(spark, "tree")
    r.load_vectors(bank, path, cell_rows=cell_rows, fanout=fanout)
    roots, nodes = (spark.read.parquet(f"{path}/{x}") for x in ("roots", "nodes"))
    assert roots.head()["levels"] >= (1 if fanout == 40 else 2)
    assert nodes.groupBy("role", "node").count().agg(F.max("count")).head()[0] <= fanout
    cells = {}
    for row in spark.read.parquet(f"{path}/blocks").collect():
        x = np.frombuffer(row["vs"]).reshape(row["n"], -1)
        cells.setdefault((row["role"], row["cell"]), []).append(x)
    whole = {key: np.concatenate(x) for key, x in cells.items()}
    assert sum(map(len, whole.values())) == len(vectors[1])
    assert all(len(x) <= cell_rows or (x == x[0]).all() for x in whole.values())
    assert collected(r.nearest(requests, path, 20)) == brute(*vectors, 20)


def test_a_search_reads_what_it_opens(spark, vectors):
    """A request for one place of one role opens few of the files, and few of the cells."""
    _, bank = frames(spark, vectors)
    path = fresh_path(spark, "tree")
    r.load_vectors(bank, path, cell_rows=16, fanout=16)
    held = spark.read.parquet(f"{path}/blocks")
    asked = materialize(bank.where("id = 1").select("role", F.col("id").alias("session_id"), F.col("embedding").cast("array<double>").alias("v")), "asked")
    start = asked.select("role", F.lit(0).cast("bigint").alias("cell"), "session_id", "v", F.lit(float("inf")).alias("bound"), F.lit(False).alias("leaf"))
    levels = spark.read.parquet(f"{path}/roots").head()["levels"]
    first = tree._descend(start, path, levels, "session_id", 5)
    read = tree.opened_blocks(first, path, tree.PARTS)
    files = read.select(F.input_file_name()).distinct().count()
    assert 1 <= files < held.select(F.input_file_name()).distinct().count() / 4
    near = r.nearest(bank.where("id = 1").select("role", "embedding", F.col("id").alias("session_id")), path, 5)
    reach = near.agg(F.max("distance")).head()[0]
    more = tree._descend(start.withColumn("bound", F.lit(reach)), path, levels, "session_id", None)
    assert more.count() < nodes_of(spark, path, "r1") / 2


def nodes_of(spark, path, role):
    return spark.read.parquet(f"{path}/nodes").where(f"leaf and role = '{role}'").count()


def test_stored_cosine_and_string_ids(spark, vectors):
    requests, bank = vectors
    asked, _ = frames(spark, vectors)
    rows = spark.createDataFrame([(f"q_{i}", role, v) for i, role, v in bank], "id string, role string, embedding array<double>")
    path = fresh_path(spark, "tree")
    r.load_vectors(rows, path, metric="cosine", cell_rows=30, fanout=5)
    got = collected(r.nearest(asked, path, 10, metric="cosine"))
    wanted = brute(requests, bank, 10, "cosine")
    assert got.keys() == wanted.keys()
    for rid, near in wanted.items():
        assert [d for _, d in got[rid]] == pytest.approx([d for _, d in near], abs=2e-6)


def test_empty_tree(spark, vectors):
    requests, bank = frames(spark, vectors)
    path = fresh_path(spark, "tree")
    r.load_vectors(bank.where("id < 0"), path)
    assert r.nearest(requests, path).count() == 0


def test_clamp_k(spark):
    got = spark.createDataFrame([(0,), (7,), (750,)], "total int").select(r.clamp_k(20, F.col("total"))).collect()
    assert [x[0] for x in got] == [1, 7, 20]


def test_embed(spark):
    rows = spark.createDataFrame(
        [(0, "Deep  learning, deep nets!"), (1, "nets deep DEEP learning"), (2, ""), (3, None), (4, "tables")], "i int, text string"
    )
    got = {x["i"]: np.array(x["embedding"]) for x in r.embed(rows).collect()}
    assert all(len(v) == r.EMBEDDING_DIMS for v in got.values())
    assert np.allclose(got[0], got[1])
    assert sorted(round(float(x), 5) for x in got[0] if x) == [round(x / 6**0.5, 5) for x in (1, 1, 2)]
    assert not got[2].any() and not got[3].any()
    assert got[0] @ got[4] < 0.9


def test_embed_with_a_callers_function(spark):
    rows = spark.createDataFrame([("ab",)], "text string")
    own = r.embed(rows, fn=lambda c: F.array(F.length(c).cast("double")))
    assert own.first()["embedding"] == [2.0]


def test_embedded_retrieval_matches_brute_force(spark):
    texts = ["join tables in sql", "train a neural net", "deploy a model", "sql window functions", "tune a neural model"]
    bank = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "id bigint, role string, text string")
    asked = spark.createDataFrame([(0, "a", "neural model"), (1, "a", "sql join")], "session_id bigint, role string, text string")
    bank, asked = r.embed(bank), r.embed(asked)
    rows = [tuple(x) for x in bank.select("id", "role", "embedding").collect()]
    questions = [tuple(x) for x in asked.select("session_id", "role", "embedding").collect()]
    got, wanted = collected(r.knn(asked, bank, 3)), brute(questions, rows, 3)
    assert {rid: x[0][0] for rid, x in got.items()} == {0: 4, 1: 0}
    for rid, near in wanted.items():
        assert [d for _, d in got[rid]] == pytest.approx([d for _, d in near], abs=1e-5)


def test_shuffles(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2 * F.col("id") % 7).alias("session_id"), F.concat(F.lit("q"), "id").alias("question"))
    placed = r.shuffle_rows(rows, seed=1).collect()
    assert placed != r.shuffle_rows(rows, seed=2).collect()
    split = r.shuffle_rows(rows, seed=1, max_group_rows=10).collect()
    assert sorted(placed) == sorted(split)
    first = {x["session_id"]: x["id"] for x in r.pick_one(rows, seed=1).collect()}
    assert first == {x["session_id"]: x["id"] for x in placed if x["place"] == 1}
    blocks = {x["session_id"]: x["reference_questions"] for x in r.reference_block(rows, 5, seed=1).collect()}
    for sid, block in blocks.items():
        mine = sorted((x["place"], x["question"]) for x in placed if x["session_id"] == sid)[:5]
        assert block == "\n".join(f"- {q}" for _, q in mine)


def test_unmatched(spark, vectors):
    requests, bank = frames(spark, vectors)
    for limit in (1000, 5):
        got = r.unmatched(requests, bank, limit).select("session_id").collect()
        assert sorted(x[0] for x in got) == [i for i, role, _ in vectors[0] if role == "none"]
