import random

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from fairlead.llm import repeats
from tests.llm.helpers import SF, brute_removed, documents


def spans_of(mask):
    out, start = [], None
    for i, m in enumerate([*mask, 0]):
        if m and start is None:
            start = i
        elif not m and start is not None:
            out.append((start, i))
            start = None
    return out


def check(spark, rows):
    found = {r["doc_id"]: r for r in repeats.remove(documents(spark, rows)).collect()}
    for i, (mask, data) in brute_removed(rows).items():
        assert [(s["start"], s["stop"]) for s in found[i]["spans"]] == spans_of(mask), i
        assert bytes(found[i]["rest"]) == bytes(b for b, m in zip(data, mask) if not m)
    assert len(found) == len(rows)


@pytest.mark.parametrize("block", [1 << 30, 20_000])
def test_documents_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    monkeypatch.setattr(repeats, "PIECE", 2000)
    check(spark, duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


def test_edges_of_matches(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 3000)
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p49, p50, p51, long = letters(49), letters(50), letters(51), letters(400)
    rows = [(1, p49 + letters(9)), (2, letters(9) + p49), (3, p50), (4, "x" + p50), (5, p51 + "y" + p50), (6, p50[1:] + p51[:-1]), (7, long), (8, long), (9, long[10:200] + letters(5) + long[180:390])]
    rows += [(10, "a" * 500), (11, "a" * 49), (12, "a" * 60 + "b" * 60), (13, "é漢" * 40), (14, "漢é" * 40), (15, None), (16, ""), (17, "zz" + long[:120] + "q" + long[120:])]
    rows += [(20 + i, letters(30) + p51 + letters(rng.randrange(80)) + long[i : i + 70]) for i in range(40)]
    check(spark, rows)


def test_long_documents_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rng = random.Random(5)
    text = "".join(rng.choice("abcde") for _ in range(3000))
    check(spark, [(2, text), (5, text[100:1700] + "Z" + text[1650:]), (9, "Q" + text), (11, text[:49])])


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from it"
    docs = documents(spark, [(1, text), (1, text), (None, text), (2, text)])
    found = sorted((r["doc_id"], r["rest"], len(r["spans"])) for r in repeats.remove(docs, ("node", "score"), as_text=True).collect())
    assert found == [(1, text, 0), (1, text, 0), (2, "", 1)]  # rows of one id do not remove each other
    assert repeats.remove(docs.limit(0)).count() == 0
    cut = repeats.remove(documents(spark, [(1, "é" * 30), (2, "aé" + "é" * 30)]), as_text=True)
    assert {r["doc_id"]: r["rest"] for r in cut.collect()} == {1: "é" * 30, 2: "a"}


def test_a_phrase_with_other_neighbours_in_each_document_is_dealt_out(spark, monkeypatch):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, tails = "LICENSED UNDER THE TERMS OF THE FILE", [letters(40) for _ in range(60)]
    rows = [(i, letters(rng.randrange(60)) + phrase + (rng.choice(tails) if i % 3 else letters(40)) + letters(rng.randrange(30))) for i in range(600)]
    for name, value in (("BLOCK", 6000), ("CROWD", 100), ("SAMPLED", 1), ("NAMES", 1000)):
        monkeypatch.setattr(repeats, name, value)
    check(spark, rows)
    crowded, contexts = repeats.crowded_grams(documents(spark, rows))
    assert len(crowded) and contexts >= 100
    # the groups that settle strings, of one block that holds all documents: no group holds much of the phrase's contexts
    table = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    key, buckets = (pa.scalar(0, pa.int32()),), 16
    flags = pa.concat_tables([repeats._compare(crowded)(repeats._send(buckets, crowded)(key, table).filter(pc.field("bucket") == b)) for b in range(buckets)])
    sizes = {}
    for r in repeats._partly(buckets, crowded, 64)(key, table, flags).to_pylist():
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + len(r["docs"]) // 8
    assert len(sizes) > 32 and max(sizes.values()) < 0.1 * sum(sizes.values())
