"""Large searches: what they move and hold, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepbank.operators import blocks, tree
from prepbank.operators import retrieve as r
from prepbank.session import fresh_path

ASKED = "session_id bigint, role string, embedding array<double>"
BANK = "id bigint, role string, embedding array<double>"


def brute(requests, bank, k):
    out = {}
    for rid, role, q in requests:
        near = [(((np.array(q) - np.array(v)) ** 2).sum().round(9), bid) for bid, b_role, v in bank if b_role == role]
        out.setdefault(rid, []).extend(near)
    return {rid: [bid for _, bid in sorted(near)[:k]] for rid, near in out.items() if near}


def collected(near):
    out = {}
    for row in sorted(near.collect(), key=lambda x: (x["session_id"], x["rank"])):
        out.setdefault(row["session_id"], []).append(row["id"])
    return out


def counted(monkeypatch):
    """Rows of every intermediate table of the tree."""
    sizes, plain = [], tree.materialize

    def counts(df, label):
        out = plain(df, label)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(tree, "materialize", counts)
    return sizes


@pytest.mark.parametrize("stored", [False, True])
def test_vectors_that_no_cell_rules_out(spark, monkeypatch, stored):
    """requests times cells are no rows where every request opens every cell."""
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(300, 24)).tolist()
    requests, bank = [(i, "a", v) for i, v in enumerate(rows)], [(i, "a", v) for i, v in enumerate(rows)]
    monkeypatch.setattr(tree, "TRIED", 16, raising=False)
    sizes = counted(monkeypatch)
    asked, index = spark.createDataFrame(requests, ASKED), spark.createDataFrame(bank, BANK)
    if stored:
        path = fresh_path(spark, "tree")
        r.load_vectors(index, path, cell_rows=8, fanout=64)
        near = r.nearest(asked, path, 5)
    else:
        near = r.knn(asked, index, 5, cell_rows=8, fanout=64)
    assert collected(near) == brute(requests, bank, 5)
    assert max(sizes) <= 4 * len(bank)


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """F3 to F8: what is scanned are the different vectors of either side."""
    rng = np.random.default_rng(9)
    some = rng.normal(size=(7, 8)).tolist()
    requests = [(i, f"r{i % 2}", some[i % 7]) for i in range(210)]
    bank = [(i, f"r{i % 3}", some[i % 5]) for i in range(600)]
    seen, plain = [], r.scan

    def counts(wanted, held, *args, **options):
        seen.append((wanted.count(), held.agg({"n": "sum"}).head()[0]))
        return plain(wanted, held, *args, **options)

    monkeypatch.setattr(r, "scan", counts)
    near = r.knn(spark.createDataFrame(requests, ASKED), spark.createDataFrame(bank, BANK), 20)
    assert collected(near) == brute(requests, bank, 20)
    assert [a <= 14 and b <= 15 for a, b in seen] == [True]


def test_an_id_that_comes_twice(spark):
    rng = np.random.default_rng(10)
    requests = [(i // 2, "a" if i % 4 else "b", v) for i, v in enumerate(rng.normal(size=(20, 4)).tolist())]
    bank = [(i, "ab"[i % 2], v) for i, v in enumerate(rng.normal(size=(80, 4)).tolist())]
    near = r.knn(spark.createDataFrame(requests, ASKED), spark.createDataFrame(bank, BANK), 5)
    assert collected(near) == brute(requests, bank, 5)


@pytest.mark.parametrize("kind", ["random", "ties", "equal", "huge", "uneven"])
def test_nearest_rows_of_a_slot(monkeypatch, kind):
    """the kernel of the scan, over several tiles."""
    for name, value in {"TILE": 16, "TILE_BANK": 50, "FIRST": 40, "DIRECT_VALUES": 600}.items():
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(11)
    q, x = rng.normal(size=(40, 6)), rng.normal(size=(400, 6))
    if kind == "ties":
        q, x = rng.integers(0, 2, q.shape).astype(float), rng.integers(0, 2, x.shape).astype(float)
    elif kind == "equal":
        x[:] = x[0]
    elif kind == "huge":
        q, x = q * 1e25, x * 1e25
    elif kind == "uneven":
        x *= np.exp(rng.normal(size=(400, 1)) * 5)
    copies = rng.integers(1, 4, len(x))
    of = np.repeat(np.arange(len(x)), copies)
    ids = rng.permutation(len(of))
    ids = ids[np.lexsort((ids, of))]
    qi, at, dist = blocks.nearest_rows(q, x, copies, pa.array(ids), 20)
    for i in range(len(q)):
        d = ((q[i] - x) ** 2).sum(1)[of]
        order = np.lexsort((ids, d))[:20]
        assert ids[at[qi == i]].tolist() == ids[order].tolist()
        assert (dist[qi == i] == d[order]).all()


def test_a_tree_that_would_go_too_deep(spark, monkeypatch):
    """numbers of cells stay within their type, whatever the vectors."""
    monkeypatch.setattr(tree, "CELL_BITS", 4, raising=False)
    rng = np.random.default_rng(12)
    rows = (rng.normal(size=(200, 3)) * np.exp(rng.normal(size=(200, 1)) * 4)).tolist()
    requests, bank = [(i, "a", v) for i, v in enumerate(rows[:10])], [(i, "a", v) for i, v in enumerate(rows)]
    path = fresh_path(spark, "tree")
    r.load_vectors(spark.createDataFrame(bank, BANK), path, cell_rows=4, fanout=4)
    assert spark.read.parquet(f"{path}/roots").head()["levels"] == 2
    assert collected(r.nearest(spark.createDataFrame(requests, ASKED), path, 5)) == brute(requests, bank, 5)


def test_few_distances_are_taken(monkeypatch):
    """of the rows within a bound, those that others rule out cost no distance."""
    taken, plain = [], blocks._first_of

    def counts(parts, rank, k):
        taken.append(sum(len(part[0]) for part in parts))
        return plain(parts, rank, k)

    monkeypatch.setattr(blocks, "_first_of", counts)
    rng = np.random.default_rng(13)
    q, x = rng.normal(size=(64, 16)), rng.normal(size=(20_000, 16))
    qi, at, _ = blocks.nearest_rows(q, x, np.ones(len(x), int), pa.array(np.arange(len(x))), 20)
    for i in range(len(q)):
        assert at[qi == i].tolist() == np.argsort(((q[i] - x) ** 2).sum(1), kind="stable")[:20].tolist()
    assert sum(taken) <= 3 * 20 * len(q)


def test_no_tree_for_vectors_that_no_cell_rules_out(spark, monkeypatch):
    """a bank is not put into a tree that is not searched; one whose cells rule most of it out is."""
    rng = np.random.default_rng(14)
    built, plain = [], tree.build_tree
    monkeypatch.setattr(tree, "build_tree", lambda *args, **options: built.append(1) or plain(*args, **options))
    monkeypatch.setattr(tree, "TRIED", 16)
    even = [(i, "a", v) for i, v in enumerate(rng.normal(size=(300, 24)).tolist())]
    near = r.knn(spark.createDataFrame(even, ASKED), spark.createDataFrame(even, BANK), 5, cell_rows=8, fanout=64)
    assert collected(near) == brute(even, even, 5)
    assert not built
    centres = rng.normal(size=(12, 4)) * 100
    apart = [(i, "a", v) for i, v in enumerate((np.repeat(centres, 25, axis=0) + rng.normal(size=(300, 4))).tolist())]
    near = r.knn(spark.createDataFrame(apart, ASKED), spark.createDataFrame(apart, BANK), 5, cell_rows=40, fanout=32)
    assert collected(near) == brute(apart, apart, 5)
    assert built


def test_pairs_of_slots_stay_apart(spark, monkeypatch):
    """small slots that are long to work on are not put together in a few tasks."""
    monkeypatch.setattr(blocks, "SLOT_ROWS", 50)
    rng = np.random.default_rng(15)
    rows = [(i, "a", v) for i, v in enumerate(rng.normal(size=(400, 4)).tolist())]
    cell = {"cell": F.lit(0).cast("bigint"), "d": F.lit(0.0)}
    asked = spark.createDataFrame(rows, "session_id bigint, role string, v array<double>").withColumns(cell)
    bank = blocks.pack(spark.createDataFrame(rows, "id bigint, role string, v array<double>").withColumns(cell), "id", gather=False)
    found = blocks.scan(asked, bank, "session_id", "id", 5, gather=False)
    assert found.rdd.getNumPartitions() >= 64
    assert collected(blocks.best_rows(found, "session_id", "id", 5)) == brute(rows, rows, 5)
