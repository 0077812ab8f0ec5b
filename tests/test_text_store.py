"""Texts by handle: what comes back, and that shuffles carry no texts."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prepbank.operators import retrieve as r
from prepbank.sources import text_store
from prepbank.sources.text_store import TextStore


def local_bytes(spark):
    """Bytes in the session's own folders: shuffles and spills."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(os.path.getsize(os.path.join(at, name)) for top in folders for at, _, names in os.walk(top.getPath()) for name in names)


def test_texts_come_back(spark):
    texts = [(0, "a"), (1, ""), (2, None), (3, "é" * 3000), (4, "x\ny"), (4, "again")]
    store = TextStore.new(spark)
    kept = store.put(spark.createDataFrame(texts, "id bigint, question string"), "question")
    assert kept.schema["question"].dataType == text_store.HANDLE
    rows = kept.groupBy((F.col("id") % 2).alias("odd")).agg(F.collect_list(F.struct("id", "question")).alias("few"))
    rows = rows.unionByName(spark.createDataFrame([(7, None), (8, [])], f"odd bigint, few {rows.schema['few'].dataType.simpleString()}"))
    out = store.get(rows, F.transform("few", lambda x: x["question"]), "texts").collect()
    assert len(out) == 4
    found = {x["odd"]: x for x in out}
    assert found[7]["texts"] is None and found[8]["texts"] == []
    back = [(x["id"], text) for odd in (0, 1) for x, text in zip(found[odd]["few"], found[odd]["texts"], strict=True)]
    assert sorted(back, key=str) == sorted(texts, key=str)


def test_parts_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(text_store, "HELD_BYTES", 10)
    monkeypatch.setattr(text_store, "GAP_BYTES", 2)
    monkeypatch.setattr(text_store, "SPAN_BYTES", 40)
    codec = text_store._codec()
    whole = [b"abc", b"", b"d" * 30, b"efgh", b"ij"]
    packed = [codec.compress(x, asbytes=True) for x in whole]
    ends = [sum(map(len, packed[: i + 1])) for i in range(5)]
    files = {0: pa.BufferReader(b"".join(packed)), 1: pa.BufferReader(packed[2])}
    handles = [{"file": 0, "at": e - len(x), "size": len(x), "raw": len(w)} for e, x, w in zip(ends, packed, whole, strict=True)]
    handles.append({"file": 1, "at": 0, "size": len(packed[2]), "raw": 30})
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in text_store.HANDLE]))
    picks = [[4, 0], [], None, [2, 5, None, 2], [3, 1, 3], [0]]
    listed = pa.array([None if p is None else [None if i is None else handles[i] for i in p] for p in picks], kind)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), listed], names=["n", "texts"])
    parts = list(text_store._held(batch, 1))
    assert [x.num_rows for x in parts] == [3, 1, 1, 1]
    out = []
    for part in parts:
        texts = text_store._read(part.column(1).flatten(), files.__getitem__, codec)
        out += text_store._lists(part.column(1), texts).to_pylist()
    said = [x.decode() for x in whole] + ["d" * 30]
    assert out == [None if p is None else [None if i is None else said[i] for i in p] for p in picks]


@pytest.fixture(scope="module")
def shown():
    """Requests with 20 near rows each out of few, long texts that do not compress; an id that comes twice, a null text."""
    draw = random.Random(3)
    texts = [(i, "".join(draw.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=60_000))) for i in range(30)]
    texts += [(4, "second text of 4"), (5, None), (30, None)]
    near = [(s, (s + 7 * n) % 31) for s in range(120) for n in range(20)]
    return near, texts


def test_reference_block_moves_no_texts(spark, shown):
    near = spark.createDataFrame(shown[0], "session_id bigint, id bigint")
    bank = spark.createDataFrame(shown[1], "id bigint, question string")
    onto = spark.range(100).select(F.col("id").alias("session_id"), (F.col("id") % 3).alias("kind"))
    before = local_bytes(spark)
    r.reference_block(near, seed=2, bank=bank, onto=onto).write.format("noop").mode("overwrite").save()
    # what is shown is 30 MB
    assert local_bytes(spark) - before < 8 << 20


def test_reference_block_of_a_bank(spark, shown, monkeypatch):
    near = spark.createDataFrame(shown[0], "session_id bigint, id bigint")
    bank = spark.createDataFrame(shown[1], "id bigint, question string")
    onto = spark.range(50, 130).select(F.lit("x").alias("kind"), F.col("id").alias("session_id"))
    plain = {x["session_id"]: x["reference_questions"] for x in r.reference_block(near.join(bank, "id"), seed=2).collect()}
    places = {}
    for x in r.first_places(near, 5, seed=2).collect():
        places.setdefault(x["session_id"], []).append((x["place"], x["id"]))
    texts = {}
    for i, text in shown[1]:
        texts.setdefault(i, []).append(text)
    want = {
        s: "\n".join(f"- {t}" for _, i in sorted(found) for t in sorted(t for t in texts[i] if t is not None)) for s, found in places.items()
    }
    assert {x["session_id"]: x["reference_questions"] for x in r.reference_block(near, seed=2, bank=bank).collect()} == want
    assert len(plain) == len(want) == 120
    some = r.reference_block(near, seed=2, bank=bank, onto=onto)
    assert some.columns == ["kind", "session_id", "reference_questions"]
    assert {x["session_id"]: x["reference_questions"] for x in some.collect()} == {s: t for s, t in want.items() if s >= 50}
    # a shared folder that only Spark reads
    monkeypatch.setattr(TextStore, "new", classmethod(lambda cls, spark: None))
    assert {x["session_id"]: x["reference_questions"] for x in r.reference_block(near, seed=2, bank=bank).collect()} == want


@pytest.mark.parametrize("limit, stored", [(r.BROADCAST_BYTES, 3), (0, 33)])
def test_texts_of_few_shown_rows_are_stored(spark, shown, monkeypatch, limit, stored):
    put, rows = TextStore.put, []
    monkeypatch.setattr(TextStore, "put", lambda self, df, text: rows.append(df.count()) or put(self, df, text))
    monkeypatch.setattr(r, "BROADCAST_BYTES", limit)
    near = spark.createDataFrame([(1, 4), (1, 7), (2, 7), (2, 99), (3, None)], "session_id bigint, id bigint")
    bank = spark.createDataFrame(shown[1], "id bigint, question string")
    found = {x["session_id"]: x["reference_questions"] for x in r.reference_block(near, bank=bank).collect()}
    assert rows == [stored]
    assert found[2] == f"- {shown[1][7][1]}" and set(found) == {1, 2} and found[1].count("\n") == 2


def test_folders_that_only_spark_reads(spark, monkeypatch):
    def unknown(uri):
        raise pa.ArrowInvalid(uri)

    monkeypatch.setattr(text_store, "_filesystem", unknown)
    assert TextStore.new(spark) is None
