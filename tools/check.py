"""Run every named query beside its checking SQL and compare rows.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from fairlead.catalog import ORACLE, QUERIES  # noqa: E402
from fairlead.session import build_session  # noqa: E402
from fairlead.sources.bindings import TABLES  # noqa: E402


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(str(r[i]) for i in order) for r in records), [columns[i] for i in order]


def main(sf_dir="/root/testdata/sf0.01", *names):
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            mine, columns = rows([tuple(r) for r in df.collect()], df.columns)
        except Exception as error:  # noqa: BLE001 - report and go on
            bad += 1
            print(f"FAIL {name}: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - started
        if name not in ORACLE:
            print(f"rows {name}: {sum(mine.values())} ({took:.1f}s)", flush=True)
            continue
        try:
            started = time.time()
            cursor = con.execute(ORACLE[name])
            theirs, expected = rows(cursor.fetchall(), [c[0] for c in cursor.description])
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"SQL  {name}: {str(error)[:800]}", flush=True)
            continue
        if columns != expected or mine != theirs:
            bad += 1
            print(f"DIFF {name}: columns {columns} {expected} rows {sum(mine.values())} {sum(theirs.values())}", flush=True)
            for label, extra in (("spark only", mine - theirs), ("sql only", theirs - mine)):
                for row in sorted(extra)[:3]:
                    print(f"     {label}: {str(row)[:600]}", flush=True)
        else:
            print(f"ok   {name}: {sum(mine.values())} rows ({took:.1f}s, sql {time.time() - started:.1f}s)", flush=True)
    print(f"{bad} bad", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
