"""Registered queries of the subpackage against their SQL."""

import collections

import duckdb
import pytest

from prepbank.llm import registered


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_query_gives_the_rows_of_its_sql(spark, data, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    out = registered.QUERIES[name](spark, data)
    found = db.execute(registered.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    wanted = collections.Counter(found.fetchall())
    assert wanted
    assert collections.Counter(map(tuple, out.select(*[f"`{n}`" for n in names]).collect())) == wanted
