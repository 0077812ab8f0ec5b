"""Top-k search, archives, the pipeline, and the guard around the subpackage."""

import collections
import hashlib
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prepbank.llm import lines, mixing, simhash, topk, warc
from prepbank.session import fresh_path

ROOT = Path(__file__).parents[2]


def best_by_hand(rows, asks, k):
    out = collections.Counter()
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for at, (q, x) in enumerate(good):
        if q is None or not asks(q):
            continue
        scores = []
        for other, (i, y) in enumerate(good):
            if other != at:
                n = min(len(x), len(y))
                scores.append((-int(x[:n] @ y[:n]), i is None, i))
        for rank, (s, _, i) in enumerate(sorted(scores, key=lambda z: z[:2] + (z[2] or 0,))[:k], 1):
            out[q, rank, i, -s] += 1
    return out


@pytest.mark.parametrize("part_rows", [50, 65_536])
def test_top_k(spark, part_rows, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.2, 1, 3])).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(100)] + [(0, rows[0][1]), (None, rows[5][1]), (400, [0.0] * 6), (500, [1.0, 2.0])]
    rows += [(600, None), (700, [1.0, None, 2.0]), (800, [float("nan")] * 6), (900, [float("inf")] * 6), (None, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("row", F.lit("x")).withColumn("part", F.lit(1))
    data = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(vectors, F.col("id") % 10 == 0, part_rows=part_rows, pivots=20).collect()
    assert collections.Counter(map(tuple, got)) == best_by_hand(data, lambda i: i % 10 == 0, 5)


def test_top_k_of_few(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(vectors, F.col("id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(vectors.where("vec_id < 0"), F.lit(True)).count() == 0


PAGES = [
    (1, "http://www.b.example.com/x?y=1#z", "<p>" + "one " * 60), (2, "https://a.example.com:8080/", "<p>" + "one " * 60),
    (3, None, None), (4, "", ""), (5, "not a url\r\nX: y", "short"), (6, "http://b.example.com/", "short"), (None, "http://c/", "<p>" + "one " * 60),
    (0, "http://[bad", "long " * 400_000), (7, "http://b.example.com/", "é\r\n\r\nWARC/1.1\r\n" * 30), (7, "http://b.example.com/", "é\r\n\r\nWARC/1.1\r\n" * 30),
    (2**60 + 1, "http://d/ü", "last"),
]


def test_archives(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, archive string, at int").repartition(3)
    folder = str(tmp_path / "warc")
    captures = warc.write_archives(pages, folder + "/archives", archive_bytes=200)
    index = warc.write_index(captures, folder + "/index", file_lines=4, block_lines=2)
    assert index.count() > 1 and index.agg(F.sum("lines")).head()[0] == len(PAGES)
    found = warc.look_up(captures.select("key").distinct(), index, folder + "/index")
    got = warc.read_records(found, folder + "/archives", payloads=True).collect()
    wanted = collections.Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        of = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None] if len(data) >= 100 else []
        first = min(of) if of else i
        wanted[i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == wanted
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    some = spark.createDataFrame([(warc.capture_key("http://www.b.example.com/x?y=1", 1),), ("com,nothing)/ +1",)], "key string")
    assert [r["page_id"] for r in warc.read_records(warc.look_up(some, index, folder + "/index"), folder + "/archives").collect()] == [1]
    assert warc.archive_round_trip(spark, pages.where("false")).count() == 0


def test_surt():
    assert warc.surt("HTTP://www.B.example.com:80/A b?c#d") == "com,example,b)/a%20b?c"
    assert warc.surt("https://x.org:444") == "org,x:444)/"
    assert warc.surt(None) == ""


def test_record_round_trip():
    data = warc.record(5, "http://a/\r\n", b"\r\n\r\nbody", "d", 3, False)
    fields, http, payload = warc.parse(warc._gunzip(warc._gzip(data)))
    assert payload == b"\r\n\r\nbody" and fields["WARC-Type"] == "response" and fields["WARC-Target-URI"] == "http://a/%0D%0A"
    with pytest.raises(ValueError):
        warc.parse(data[:-1])


def test_pipeline_stage_by_stage(spark, data, odd):
    """Each stage keeps the columns of documents and takes its operator's decisions over."""
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(
        odd.select((F.col("doc_id") + 10**7).alias("doc_id"), "text", "lang", "source", "n_chars")
    )
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        path = fresh_path(spark, "stage")
        stage(spark, docs, data).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "packing":
            assert after.columns == docs.columns
        before = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        if name == "language ID":
            kept = {r["doc_id"] for r in after.collect()}
            letters = {r["doc_id"] for r in docs.where(F.rlike("text", F.lit(r"\p{L}"))).collect()}
            assert kept == letters
        elif name == "line dedup":
            assert collections.Counter(r["doc_id"] for r in after.collect()) == before
            assert sorted(map(str, after.collect())) == sorted(map(str, lines.drop_boilerplate(docs).collect()))
        elif name == "near-dedup":
            groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
            assert collections.Counter(r["doc_id"] for r in after.collect()) == collections.Counter(groups)
        elif name == "mixing":
            copies = collections.Counter()
            for r in mixing.mix(docs).collect():
                copies[r["doc_id"]] += r["copies"]
            assert collections.Counter(r["doc_id"] for r in after.collect()) == +copies
        else:
            assert collections.Counter(r["doc_id"] for r in after.where("piece = 0").collect()) == before
        docs = after


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_the_rest_works_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[0] == 'corpus_pipeline' or name.startswith('prepbank.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'c1_knn' in e.queries() and 'pipeline' not in e.queries() and 'op6_line_dedup' not in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
