"""Named queries over a few rows of their own, beside their checking SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as contract
from fairlead.sources import bindings as b


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Forty orders of two customers, three suppliers, each order with two line items."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = {
        "nation": ([(0, "N", 0), (2, "K", 3)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, "Org A", 0), (2, "Org B", 2)], "c_custkey long, c_name string, c_nationkey int"),
        "supplier": ([(1, 0), (2, 2), (3, 0)], "s_suppkey long, s_nationkey int"),
        "orders": (
            [(k, 1 + k % 2, datetime.date(1999, 1, 1) + datetime.timedelta(days=17 * k), f"{1 + k % 5}-X") for k in range(1, 41)],
            "o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string",
        ),
        "lineitem": ([(k, 1 + (k + n) % 3, n) for k in range(1, 41) for n in (1, 2)], "l_orderkey long, l_suppkey long, l_linenumber int"),
    }
    for name, (data, layout) in rows.items():
        spark.createDataFrame(data, layout).write.parquet(f"{at}/{name}.parquet")
    return at


def beside_sql(spark, at, name):
    con = duckdb.connect()
    for table in ("nation", "customer", "supplier", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{at}/{table}.parquet/*.parquet')")
    df = contract.queries()[name](spark, at)
    cursor = con.execute(contract.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    mine = sorted(str([r[c] for c in names]) for r in df.collect())
    assert mine == sorted(str(list(r)) for r in cursor.fetchall())
    return df


def test_sections_hold_every_line_under_the_title_too(spark, tables):
    df = beside_sql(spark, tables, "sections")
    title = b.view(spark, tables, "notices").where("notice_id = 10").first().title.lower()
    lines = {name: [r.line for r in df.where("notice_id = 10").collect() if r.name == name] for name in ("funding", title)}
    assert lines["funding"] and set(lines["funding"]) < set(lines[title])
