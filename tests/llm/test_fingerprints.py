import hashlib

import duckdb
from pyspark.sql import functions as F

from fairlead.llm import fingerprints as fp
from fairlead.llm.catalog import QUERIES
from tests.llm.helpers import SF, documents, odd_documents, shingle_set


def test_query_against_brute_force(spark):
    rows = sorted(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    df = QUERIES["op7_minhash_prints"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found, off, prints = {r["doc_id"]: r for r in df.collect()}, [], {}
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1] or ""
        text = text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        prints.setdefault(text, set()).add(found[i]["fingerprint"])
        for other, near in ((edited, found[i]["near_edited"]), (after, found[i]["near_next"])):
            a, b = shingle_set(text), shingle_set(other)
            off.append(abs(near - len(a & b) / max(1, len(a | b))))
            assert 0 <= near <= 1
    assert all(len(p) == 1 for p in prints.values())
    assert sum(off) / len(off) < 0.03 and max(off) < 0.25


def test_likeness_of_short_and_empty_texts(spark):
    df = spark.createDataFrame([("", ""), ("", "a"), (None, None), ("a b", "a b"), ("a b", "a c"), ("A b", "a  b ")], "a string, b string")
    near = df.select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("n")).collect()
    assert [round(r["n"], 2) for r in near] == [1.0, 0.0, 1.0, 1.0, 0.0, 1.0]
    assert len(df.select(fp.as_text(fp.fingerprint(F.col("a"))).alias("t")).collect()[3]["t"]) == 2 * fp.BINS


def test_odd_rows(spark):
    rows = fp.edited(documents(spark, odd_documents())).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1, 10))  # ids once, rows without one left out
    assert fp.edited(documents(spark, [])).count() == 0
    alone = fp.edited(documents(spark, [(5, "abcd")])).collect()[0]
    assert alone["edited_text"] == "abab"  # the last document is followed by the first


def test_ranges_of_ids_link_up(spark):
    ids = [i * i for i in range(1000)] + [10**12]
    rows = fp.successors(spark.createDataFrame([(i,) for i in ids], "doc_id long"), ranges=7).collect()
    assert {r["doc_id"]: r["next"] for r in rows} == dict(zip(ids, [*ids[1:], ids[0]]))
