import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fairlead.llm import jaccard
from fairlead.llm.components import components
from fairlead.llm.shingles import document_sets
from tests.llm.helpers import SF, brute_components, documents, odd_documents, shingle_set


def run(spark, rows, **options):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(documents(spark, rows), **options).collect()}


def test_documents_against_brute_force(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert run(spark, rows) == brute_components(rows)


@pytest.fixture(scope="module")
def families():
    """Texts around one another at likenesses on both sides of 0.8, a common passage, and copies."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passage, rows = [word() for _ in range(12)], []
    for base in range(6):
        text = passage * (base % 2) + [word() for _ in range(rng.randrange(30, 90))]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy + [word()] * rng.randrange(4)))
    rows += [" ".join(passage), " ".join(passage + ["x"]), "a b c", "A b\tc", "a b", ""] + rows[:5]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 3])
def test_families(spark, families, block):
    assert run(spark, families, block=block) == brute_components(families)


def test_exact_threshold(spark):
    words = [f"w{i}" for i in range(13)]  # 9 shingles; one more word makes 10
    shared = [" ".join(words), " ".join(words[:-1]), " ".join(words[:-2]), " ".join(words[:-3])]
    assert run(spark, list(enumerate(shared))) == brute_components(list(enumerate(shared)))


def test_odd_rows(spark):
    found = jaccard.groups(documents(spark, odd_documents())).collect()
    assert len(found) == len(odd_documents())
    by_id = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None}
    assert by_id[1] == by_id[2] and by_id[7][1] == 1 and by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5)
    assert jaccard.groups(documents(spark, [])).count() == 0


def test_sets_have_the_right_sizes():
    texts = [t for _, t in odd_documents()]
    assert [len(s) for s in document_sets(pa.array(texts, pa.string()))] == [len(shingle_set(t)) for t in texts]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_a_handful_is_sifted_without_losing_a_link():
    rng = np.random.default_rng(4)
    for _ in range(200):
        base = rng.integers(0, 1 << 63, int(rng.integers(5, 60))).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype(np.uint64)])) for _ in range(int(rng.integers(2, 9)))]
        sizes, sketches = np.array([len(s) for s in sets]), [jaccard.sketch_of(s) for s in sets]
        for right in (None, rng.random(len(sets)) < 0.5):
            many = np.flatnonzero(jaccard.possible(sizes, sketches, right)).tolist()
            few = jaccard._possible_few(sizes.tolist(), sketches, None if right is None else right.tolist(), 80)
            pairs = [(i, j) for i in range(len(sets)) for j in range(i) if right is None or right[i] != right[j]]
            linked = {k for i, j in pairs if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for k in (i, j)}
            assert linked <= set(few) <= set(many)


def test_fragments_cut_the_global_order(spark, families):
    levels, fragments = jaccard.order_of(documents(spark, families))
    order = np.lexsort((np.arange(len(levels)), levels))
    assert (np.diff(fragments[order].astype(int)) >= 0).all() and set(fragments) == set(range(jaccard.FRAGMENTS))


def test_marks_hold_every_node(spark):
    nodes = [*range(-50, 50), 2**62 + 5, -(2**63)]
    marks = jaccard.marks_of(spark.createDataFrame([(n,) for n in nodes], "node long"))
    marked = lambda n: marks[(n & 8 * len(marks) - 1) >> 3] >> (n & 7) & 1
    assert all(marked(n) for n in nodes) and not any(marked(n) for n in range(100, 5000))
