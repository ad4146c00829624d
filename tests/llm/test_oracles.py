"""The queries that SQL can express, against it, over whole tables."""

import duckdb
import pytest

from tickstrata.llm import queries


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns).collect()
    plain = lambda rows: sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)
    assert plain(got) == plain(want.fetchall())


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
