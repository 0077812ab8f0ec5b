"""Sharding, mixing and line dedup: laws, odd rows, empty tables, and plans without Python."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from prepbank.llm import lines, mixing, shard


def plan(df):
    return df._jdf.queryExecution().toString()


def test_shards(odd, odd_rows, none):
    out = shard.assign_shards(odd, [1.0] * 5, bucket_rows=4)
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    rows = out.collect()
    assert len(rows) == len(odd_rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["grown_shard"] for r in rows if r["grown_shard"] != r["shard"]} <= {5}
    wanted = collections.Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert wanted == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert shard.assign_shards(none, [1.0]).count() == 0


def test_shard_weights_and_growth(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = shard.assign_shards(docs, [1.0, 1.0, 2.0], grown_weight=1.0).collect()
    share = collections.Counter(r["shard"] for r in rows)
    assert [share[s] / 40_000 for s in range(3)] == pytest.approx([0.25, 0.25, 0.5], abs=0.01)
    moved = sum(r["grown_shard"] == 3 for r in rows)
    assert moved / 40_000 == pytest.approx(0.2, abs=0.01)
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)


def test_write_shards(odd, odd_rows, tmp_path):
    shard.write_shards(odd.drop("shard"), str(tmp_path / "out"), [1.0] * 3, files=2)
    assert odd.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(odd_rows)


def targets_by_hand(sizes, weights=(5, 2, 1), cap=3):
    """{source: target} by sharing again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed_at, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed_at]
        rest = total - sum(fixed_at.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > cap * sizes[s]]
        if not above:
            return fixed_at | share
        fixed_at |= {s: cap * sizes[s] for s in above}


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 400)), ["a", "b", "c", "d", None][i % 5]) for i in range(900)]
    rows += [(1000 + i, "same text " * 50, "d") for i in range(700)] + [(5000, "one two", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs, class_rows=64)
    got = out.collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), class_rows=64).collect()), key=str)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    wanted = targets_by_hand(sizes)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
    for source, target in wanted.items():
        assert taken[source] == pytest.approx(target, rel=0.01)
    # Rates are tilted exponentially by size below the cap.
    for source in "bcd":
        rates = {r["size"]: r["rate"] for r in got if r["source"] == source and r["rate"] < 3}
        tilt = [math.log(rate) / size for size, rate in rates.items()]
        assert rates and max(tilt) - min(tilt) <= 1e-8
    repeated = mixing.repeat_documents(docs, out)
    assert repeated.columns == docs.columns
    counts = collections.Counter(r["doc_id"] for r in repeated.collect())
    assert counts == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_mix_odd_rows(odd, odd_rows, none):
    got = mixing.mix(odd)
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    assert sum(r["size"] for r in rows) == sum(len((r[1] or "").encode().split()) for r in odd_rows)
    assert mixing.repeat_documents(odd, got).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(none).count() == 0
    only_blank = odd.where("doc_id in (100, 101, 102)")
    assert {r["taken"] for r in mixing.mix(only_blank).collect()} == {0}


def lines_by_hand(rows, ratio, least):
    pages = collections.defaultdict(set)
    for _, text, source in rows:
        if text is not None:
            pages[source].add(text)
    bad = set()
    for source, texts in pages.items():
        n = collections.Counter(x for t in texts for x in {y.strip(" \t\r") for y in t.split("\n")})
        bad |= {(source, x) for x, c in n.items() if x and c >= least and c > ratio * len(texts)}
    return [None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" \t\r")) not in bad) for _, t, s in rows]


def test_line_dedup(odd, odd_rows, none):
    out = lines.drop_boilerplate(odd, "source", "text", 0.1, 3, "n_dropped")
    assert "Python" not in plan(out) and "Pandas" not in plan(out)
    assert out.columns == [*odd.columns, "n_dropped"]
    wanted = lines_by_hand([(r[0], r[1], r[3]) for r in odd_rows], 0.1, 3)
    got = out.collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(
        (r[0], t) for r, t in zip(odd_rows, wanted, strict=True)
    )
    assert sum(r["n_dropped"] for r in got) == 26
    assert lines.drop_boilerplate(none).count() == 0


def test_copied_pages_are_no_boilerplate(spark):
    rows = [(i, "copied page\nwith two lines" if i < 60 else f"own {i}\nfooter", "s") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == "copied page\nwith two lines" and got[99] == "own 99"


def test_lines_of_small_hosts_and_long_lines(spark):
    """On three of five pages a line goes, on two it stays; on a large host a long passage goes once it is on more than the ratio."""
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(i, f"own {i}\nmenu" + ("\ntwice" if i < 2 else ""), "small") for i in range(5)]
    rows += [(100 + i, f"text {i}" + (f"\n{passage}" if i < 5 else "") + ("\nfew" if i % 50 == 0 else ""), "large") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(docs).collect()}
    assert got[0] == "own 0\ntwice" and got[4] == "own 4"
    assert got[101] == "text 1" and got[150] == "text 50\nfew"
    assert [got[i] for i, _, _ in rows] == lines_by_hand(rows, lines.RATIO, lines.LEAST)
