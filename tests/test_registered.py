"""Every registered query against its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from prepbank.plans.registered import base

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return connection


def plain(rows):
    def value(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x + 0.0)
        return repr(x)

    return sorted(tuple(value(x) for x in row) for row in rows)


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(base.QUERIES) <= set(entry.queries()) and set(base.SQL) <= set(entry.oracle_sql())
    assert set(base.QUERIES) == set(base.SQL)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, db, name):
    out = entry.queries()[name](spark, data)
    columns = sorted(out.columns)
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = plain([row[i] for i in at] for row in found.fetchall())
    assert wanted, "the check is empty"
    assert plain(out.select(*[f"`{c}`" for c in columns]).collect()) == wanted


def test_embedded_retrieval_rows(spark, data):
    """Every request whose role has bank rows gets 20 of them, nearest first."""
    rows = entry.queries()["flow_embedded_retrieval"](spark, data).collect()
    per = {}
    for r in rows:
        per.setdefault(r["session_id"], []).append((r["rank"], r["distance"]))
    assert per and all([rank for rank, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in per.values())
    assert all([d for _, d in sorted(x)] == sorted(d for _, d in x) for x in per.values())
