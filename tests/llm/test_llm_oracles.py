"""The operators' queries that SQL can state, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from quarrystone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    d = queries.queries()[name](spark, SF)
    columns = sorted(d.columns)
    r = c.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert sorted(tuple(x[k] for k in columns) for x in d.collect()) == sorted(tuple(x[names.index(k)] for k in columns) for x in r.fetchall())
