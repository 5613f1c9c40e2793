"""The queries that SQL can express, against DuckDB, on the whole small tables."""

import duckdb
import pytest

pytest.importorskip("public_tokenizers")

from kinetrove.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = [tuple(r[n] for n in names) for r in queries()[name](spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall())) and got
