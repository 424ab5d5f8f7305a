"""Named queries against their checking SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from fairlead.sources.bindings import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("canonical_url", "links", "sentences", "derive_status", "dedup", "geo_match", "search_merge", "change_track", "retry_set", "query_plan")


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = contract.queries()[name](spark, SF)
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    mine = sorted(str([r[c] for c in names]) for r in df.collect())
    assert mine == sorted(str(list(r)) for r in cursor.fetchall())
