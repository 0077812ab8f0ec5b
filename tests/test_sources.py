"""Files, index, score table, assembled texts."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from prepbank import session
from prepbank.operators import bank as b
from prepbank.plans.registered.scores import new_table
from prepbank.session import fresh_path, shared_dir
from prepbank.sources import bank_files, score_log
from prepbank.sources.ledger import Ledger


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_read_bank(spark, folder):
    with open(folder + "/bank.jsonl", "w", encoding="utf-8") as f:
        f.write('{"role":"x","question":"é?"}\n \t\n{bad\n{"type":"B","tags":["a"],"extra":{"n":1}}\n[1]\n{"role":null}\n{"a":1} x\n')
    got = {r["id"]: r for r in bank_files.read_bank(spark, folder + "/bank.jsonl").collect()}
    assert sorted(got) == ["q_0", "q_3", "q_5"]
    assert (got["q_0"]["role"], got["q_0"]["question"], got["q_0"]["type"]) == ("x", "é?", "Technical")
    assert (got["q_3"]["role"], got["q_3"]["type"], got["q_3"]["tags"]) == ("", "B", ["a"])
    assert got["q_5"]["role"] == ""


def test_bank_without_line_numbers_is_read_and_parsed_once(spark, folder):
    """Lines are counted only where their numbers are used; rows are the same either way."""
    for no in range(3):
        with open(f"{folder}/bank-{no}.jsonl", "w", encoding="utf-8") as f:
            f.write('{"role":"x","question":"same"}\n' * 2 + ' \n\n{bad\nnull\n[1]\n"x"\n7\n{}\n{"role":null,"question":null}\n{"a":1} {}\n')
    open(f"{folder}/empty.jsonl", "w").close()
    bank = bank_files.read_bank(spark, folder)
    plain = bank.select("role", "question", "type")
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and plan.count("parseJson") == 1
    rows = bank.select("line_no", "role", "question", "type").collect()
    assert sorted(r["line_no"] for r in rows) == [12 * no + at for no in range(3) for at in (0, 1, 9, 10)]
    assert sorted(tuple(r) for r in plain.collect()) == sorted(tuple(r)[1:] for r in rows)
    assert sorted(tuple(r)[1:] for r in rows) == sorted([("x", "same", "Technical")] * 6 + [("", "", "Technical")] * 6)


def test_line_ids_over_many_splits(spark, folder):
    """Small splits, several files: numbers follow the files' names and positions."""
    lines = [f"line {i} " + "x" * (i % 90) if i % 11 else "" for i in range(4000)]
    for no in range(4):
        with open(f"{folder}/part-{no}.txt", "w") as f:
            f.write("\n".join(lines[no * 1000 : (no + 1) * 1000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = bank_files.line_ids(spark, folder)
        assert numbered.rdd.getNumPartitions() > 8
        got = dict(numbered.select("line_no", "value").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == dict(enumerate(lines))


def test_write_and_append(spark, folder):
    rows = spark.createDataFrame([("r", "ü \"x\" \\ \n y")], "role string, question string")
    bank_files.write_bank(rows, folder + "/bank")
    bank_files.write_bank(rows, folder + "/bank")
    bank_files.append_bank(rows.withColumn("type", F.lit("Behavioral")), folder + "/bank")
    got = bank_files.read_bank(spark, folder + "/bank").select("question", "type").collect()
    assert sorted(tuple(r) for r in got) == [("ü \"x\" \\ \n y", "Behavioral"), ("ü \"x\" \\ \n y", "Technical")]
    raw = "".join(open(f"{folder}/bank/{p}", encoding="utf-8").read() for p in os.listdir(folder + "/bank") if p.endswith(".json"))
    assert "ü" in raw


def test_index_loads_once(spark, folder):
    rows = spark.range(50).select(
        F.concat(F.lit("q_"), "id").alias("id"), F.concat(F.lit("r"), F.col("id") % 3).alias("role"),
        F.lit("q").alias("question"), F.lit("a").alias("model_answer"), F.lit("Technical").alias("type"),
    )
    path = folder + "/index"
    assert bank_files.load_index(bank_files.bank_or_none(spark, folder + "/none"), path) is False
    assert bank_files.load_index(b.index_rows(rows), path) is True
    assert bank_files.load_index(b.index_rows(rows.limit(1)), path) is False
    index = bank_files.read_index(spark, path)
    assert index.count() == 50
    plan = index.where("role = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(coalesce(role" in plan


def test_index_keeps_odd_roles(spark, folder):
    rows = spark.createDataFrame([("a", ""), ("b", "01"), ("c", "x/y=z %")], "id string, role string")
    assert bank_files.load_index(rows, folder + "/index")
    got = {r["id"]: r["role"] for r in bank_files.read_index(spark, folder + "/index").collect()}
    assert got == {"a": "", "b": "01", "c": "x/y=z %"}


def test_files_are_routed(spark, folder):
    for name in ("a.PDF", "b.docx", "c.txt"):
        with open(f"{folder}/{name}", "w") as f:
            f.write("x")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["message"]) for r in bank_files.list_files(spark, folder).collect()}
    assert got == {"a.PDF": ("pdf", None), "b.docx": ("docx", None), "c.txt": ("unsupported", "Only PDF or DOCX files are supported.")}


@pytest.mark.parametrize("part, group", [(1 << 20, 1 << 28), (6, 1 << 28), (6, 8), (1 << 20, 8), (1, 1)])
def test_assemble_text(spark, part, group):
    texts = {
        0: [" ", "\n", "  a ", "b", " ", "c \n", "\t"],
        1: ["one"],
        2: ["", " ", ""],
        3: ["x" + str(i) for i in range(10)],
        4: [None, "y", None, "z"],
    }
    rows = [(k, i, t) for k, parts in texts.items() for i, t in enumerate(parts)]
    parts = spark.createDataFrame(rows, "key int, part int, text string").repartition(5)
    got = {}
    for r in bank_files.assemble_text(parts, "key", "part", "text", part, group).orderBy("key", "part_no").collect():
        got.setdefault(r["key"], []).append(r["text"])
    assert {k: "\n".join(v) for k, v in got.items()} == {
        k: "".join((t or "") + "\n" for t in parts).strip() for k, parts in texts.items()
    }
    assert all(len(v) == 1 for v in got.values()) or part < 1 << 20
    lines = {}
    for r in bank_files.text_lines(parts, "key", "part", "text", 3, group).orderBy("key", "line_no").collect():
        lines.setdefault(r["key"], []).append(r["text"])
    assert {k: "\n".join(v) for k, v in lines.items()} == {k: "\n".join(v) for k, v in got.items()}


@pytest.fixture
def table(spark):
    path = fresh_path(spark, "test")
    name = f"db_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    score_log.init_history(spark, f"{name}.history")
    return f"{name}.history"


def test_score_table(spark, table):
    def append(n, limit=1_000_000):
        rows = spark.range(n).select(F.lit("s").alias("session_id"), F.concat(F.lit("q"), "id").alias("question"), F.lit(7).alias("score"))
        score_log.log_scores(rows, table, max_group_rows=limit)

    append(3)
    append(40, 10)
    score_log.init_history(spark, table)
    got = spark.table(table).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 44))
    assert [r["question"] for r in got[:3]] == ["q0", "q1", "q2"]
    assert all(r["timestamp"].microsecond == 0 and r["score"] == 7.0 for r in got)
    score_log.clear_history(spark, table)
    assert spark.table(table).count() == 0
    score_log.clear_history(spark, table)
    append(2)
    assert sorted(r["id"] for r in spark.table(table).collect()) == [44, 45]


def some_scores(spark, lo, hi):
    return spark.range(lo, hi).select(F.lit("s").alias("session_id"), F.format_string("q%05d", "id").alias("question"), F.lit(7.0).alias("score"))


def test_an_append_that_is_run_again_adds_nothing(spark, table):
    for batch in ("one", "a key / with 'signs' =ü"):
        before = score_log.read_history(spark, table).count()
        assert score_log.log_scores(some_scores(spark, 0, 30), table, batch=batch) is True
        assert score_log.log_scores(some_scores(spark, 0, 30), table, batch=batch) is False
        assert score_log.read_history(spark, table).count() == before + 30
    assert sorted(r["id"] for r in spark.table(table).collect()) == list(range(1, 61))
    score_log.clear_history(spark, table)
    assert score_log.log_scores(some_scores(spark, 0, 30), table, batch="one") is False
    assert spark.table(table).count() == 0 and score_log.last_id(spark, table) == 60


def test_an_append_that_stops_halfway_is_written_anew(spark, table):
    """Before its rows are published nobody sees them; the second run gives the same ids, and the files of the first are gone."""
    score_log.log_scores(some_scores(spark, 0, 5), table, batch="first")
    bad = some_scores(spark, 0, 20).withColumn("score", F.when(F.col("question") == "q00019", F.raise_error(F.lit("stopped"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="stopped"):
        score_log.log_scores(bad, table, batch="second")
    # A writer that had its ids and files but stopped ahead of the catalog.
    assert score_log._ledger(spark, table).claim("second", 20) == 6
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").head()[1]
    spark.range(3).write.parquet(f"{folder}/batch=ksecond")
    assert score_log.read_history(spark, table).count() == 5
    score_log.log_scores(some_scores(spark, 0, 4), table, batch="third")
    assert score_log.log_scores(some_scores(spark, 0, 20), table, batch="second") is True
    got = spark.table(table).collect()
    assert sorted(r["id"] for r in got if r["batch"] == "ksecond") == list(range(6, 26))
    assert sorted(r["id"] for r in got) == list(range(1, 30))


def test_writers_at_the_same_time_get_disjoint_ids(spark, table):
    with ThreadPoolExecutor(6) as pool:
        done = [pool.submit(score_log.log_scores, some_scores(spark, 0, 5 + i), table, batch=f"w{i % 5}") for i in range(6)]
        assert sum(x.result() for x in done) >= 5
    got = spark.table(table).collect()
    ids = [r["id"] for r in got]
    assert len(ids) == len(set(ids)) and {r["batch"] for r in got} == {f"kw{i}" for i in range(5)}
    assert all({r["id"] for r in got if r["batch"] == b} == set(range(min(x), max(x) + 1)) for b in {r["batch"] for r in got} for x in [[r["id"] for r in got if r["batch"] == b]])


def test_ledger(spark, folder):
    ledger = Ledger(spark, folder + "/ledger")
    assert ledger.last() == 0
    assert [ledger.claim("a", 3), ledger.claim("b", 2), ledger.claim("a", 3), ledger.claim("c", 0), ledger.claim("d", 1)] == [1, 4, 1, 6, 6]
    assert ledger.last() == 6
    assert ledger.files.create_once("x/y", {"v": 1}) is True and ledger.files.create_once("x/y", {"v": 2}) is False
    assert ledger.files.read("x/y") == {"v": 1}
    with ThreadPoolExecutor(8) as pool:
        firsts = list(pool.map(lambda i: ledger.claim(f"t{i}", 10), range(24)))
    assert sorted(firsts) == list(range(7, 7 + 240, 10))


def test_repeated_bank_append(spark, folder):
    path = folder + "/bank"

    def rows(lo, hi):
        return spark.range(lo, hi).select(F.lit("r").alias("role"), F.format_string("q%d", "id").alias("question"), F.lit("a").alias("model_answer")).coalesce(1)

    bank_files.write_bank(rows(0, 4), path)
    assert bank_files.append_bank(rows(4, 6), path, "soft") is True
    assert bank_files.append_bank(rows(4, 6), path, "soft") is False
    # One that stopped ahead of the move: unseen, and written anew under its number.
    ledger = Ledger(spark, path + "/_ledger")
    assert ledger.claim("late", 1) == 2
    rows(90, 95).write.json(path + "/_draft-stopped")
    assert bank_files.append_bank(rows(8, 9), path) is True
    assert bank_files.append_bank(rows(6, 8), path, "late") is True
    got = bank_files.read_bank(spark, path).orderBy("line_no").collect()
    assert [(r["id"], r["question"]) for r in got] == [(f"q_{i}", f"q{i}") for i in range(9)]


def test_shared_dir_comes_from_the_session(spark, folder):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (before or shared_dir(spark))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_payload(spark):
    rows = spark.createDataFrame([(1, "q \"x\"", None)], "id int, question string, source string")
    assert bank_files.to_payload(rows, "id").first()["payload"] == '{"question":"q \\"x\\""}'


def test_clean_up_removes_what_was_written(spark, folder, monkeypatch):
    monkeypatch.setattr(session, "_own_dir", lambda spark: f"{folder}/own")
    kept = session.materialize(spark.range(3), "rows")
    table = new_table(spark, "scores")
    assert kept.count() == 3 and spark.catalog.tableExists(table)
    session.clean_up(spark)
    assert not os.path.exists(f"{folder}/own") and not spark.catalog.databaseExists(table.split(".")[0])
    session.clean_up(spark)
