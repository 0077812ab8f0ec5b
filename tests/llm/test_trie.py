"""Prefix trie against dictionaries of whole prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from prepbank.llm import registered, trie
from prepbank.session import materialize

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """{conv: [(role, text)]} in order."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def trie_by_hand(seqs):
    members = collections.defaultdict(list)
    for c, turns in sorted(seqs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = collections.Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(seqs[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out[m[0], len(p), parent, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def made(seed):
    """Conversations with common beginnings, a very long one and its copies, a hot first turn, nulls, ties and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in range(300):
        turns = ["hot"] if c % 3 else []
        turns += [rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0 if turns else 1, 6))]
        rows += [(c * 7 - 300, i, "u", t) for i, t in enumerate(turns)]
    long = [rng.choice("xyz") for _ in range(700)]
    for c, n in ((9000, 700), (9001, 700), (9002, 400), (9003, 1)):
        rows += [(c, i, None, t) for i, t in enumerate(long[:n])]
    rows += [(9004, 1, "b", "tie"), (9004, 1, "a", "tie"), (9004, None, "z", None), (9004, None, "z", None), (2**60 + 1, 5, "é", "ü" * 9)]
    rows += [(None, 1, "u", "none"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("limit, run, group", [(10**9, 1024, None), (40, 64, 100)])
def test_trie(spark, monkeypatch, limit, run, group):
    monkeypatch.setattr(trie, "RUN", run)
    rows = made(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, owner string").repartition(4)
    got = trie.prefix_trie(df, limit=limit, max_group_rows=group)
    assert got.columns == COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == trie_by_hand(sequences(rows))


def test_grafts(spark):
    rows = [r for r in made(2) if r[0] is None or r[0] < 3000]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    turns = materialize(trie.ordered_turns(df), "turns")
    conv = F.col("conv")
    got = trie.trie_report(*trie.graft(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, 8), limit=50)
    own = sequences(rows)
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    assert any(not turns for turns in rebuilt.values())
    assert collections.Counter(map(tuple, got.collect())) == trie_by_hand(rebuilt)


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).count() == 0


def test_centroids():
    rng = random.Random(4)
    for n in (1, 2, 50, 400):
        parent = [-1, *[rng.randint(max(0, i - 3), i - 1) for i in range(1, n)]]
        sub, values = [1] * n, [rng.randint(-5, 9) for _ in range(n)]
        wanted = list(values)
        for i in range(n - 1, 0, -1):
            sub[parent[i]] += sub[i]
            wanted[parent[i]] += wanted[i]
        assert trie.centroid_totals(parent, sub, [values]) == [wanted]


def test_ids_over_several_pieces(spark):
    rows = [(c, 1, "u", "same") for c in range(-5000, 9000, 2)]
    got = {r["depth"]: r for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert got[0]["n_convs"] == 7000 and got[0]["saved_tokens"] == 6999 * 4


def test_registered(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = sequences(rows)
    rebuilt = {c: own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + own[c][h:] for c in own}
    got = registered.QUERIES["op13_conversation_trie"](spark, data)
    assert collections.Counter(map(tuple, got.collect())) == trie_by_hand(rebuilt)
