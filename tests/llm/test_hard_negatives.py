import duckdb
import numpy as np
import pytest

from fairlead.llm import catalog, hard_negatives

NAN, INF = float("nan"), float("inf")


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    """rows: (id, label, vector of ints), ids distinct."""
    out = set()
    product = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, label, v in rows:
        if a in anchors:
            scored = sorted((-product(v, w), i, other) for i, other, w in rows if i != a)
            for p, i, other in [s for s in scored if s[2] == label][:positives]:
                fits = [(s, j) for s, j, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
                out |= {(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fits[:negatives], 1)}
    return out


def run(spark, rows, anchors, **kind):
    vectors = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    chosen = spark.createDataFrame([(a,) for a in anchors], "vec_id long")
    found = hard_negatives.hard_negatives(vectors, chosen, **kind)
    return {tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SLICE", 60), ("ANCHORS", 6), ("DEPTH", 2)):
        monkeypatch.setattr(hard_negatives, name, value)


def test_against_brute_force_over_many_slices(spark, small):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-30, 60, 5).tolist()) for i in range(240)]
    rows += [(300 + i, i % 2, [20, 20, 0, 0, 0]) for i in range(80)]  # copies: ties go to the smaller id
    rows += [(400, 1, [0] * 5), (401, 9, [5] * 5), (402, 2, []), (403, 2, [10, 20])]
    anchors = [i for i in range(404) if i % 10 == 0] + [401]
    found = run(spark, rows, anchors)
    assert found == brute(rows, anchors) and len(found) > 300
    assert run(spark, rows, anchors, positives=2, negatives=5, low=80, high=100) == brute(rows, anchors, 2, 5, 80, 100)


def test_few_rows_and_none(spark):
    rows = [(0, 1, [4, 0]), (1, 1, [10, 0]), (2, 2, [6, 1]), (3, 2, [-6, 1])]
    assert run(spark, rows, [0, 2]) == brute(rows, [0, 2]) == {(0, 1, 1, 2, 40, 24)}
    assert run(spark, rows, []) == set() and run(spark, [], [1]) == set()
    assert run(spark, [(1, 1, [5])], [1]) == set()


def test_repeated_ids_nulls_and_large_numbers(spark):
    big = 1 << 26
    rows = [(0, 1, [big, 3]), (1, 1, [big, 5]), (2, 2, [big * 9 // 10, 1]), (3, 2, [big * 9 // 10, 2])]
    odd = [(1, 1, [big, 5]), (1, 2, [1, 1]), (None, 2, [big, 0]), (7, None, [big, 0]), (8, 2, None)]
    assert run(spark, rows + odd, [0]) == brute(rows, [0])


def test_lists_are_left_as_soon_as_the_threshold_falls_below():
    rng = np.random.default_rng(2)
    x = np.sort(rng.integers(0, 1000, (4000, 3)), axis=0)  # one order in all dimensions: the best rows stand first
    found = hard_negatives.Lists(np.arange(4000), np.zeros(4000, int), x)
    met = []
    read = found.read
    found.read = lambda anchor: (met.append(len(step[0])) or step for step in read(anchor))
    anchor = np.array([2, 3, 5])
    (ids, scores), = hard_negatives.mine(found, anchor, np.ones(4000, bool), [(hard_negatives.LEAST, hard_negatives.MOST, hard_negatives.LEAST)], 5)
    order = np.lexsort((np.arange(4000), -(x @ anchor)))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == (x @ anchor)[order].tolist()
    assert sum(met) < 200


def test_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist(), int(rng.integers(0, 3)), "x") for i in range(300)]
    rows += [(350, None, 1, ""), (400, [1.0, None, 0.0, 0.0], 1, ""), (450, [NAN] * 4, 1, ""), (500, [0.0, -INF, 0.0, 0.0], 1, ""), (550, [1.0] * 4, None, ""), (None, [1.0] * 4, 1, "")]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, slice string").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    cursor = con.execute(catalog.ORACLE["op13_hard_negatives"])
    columns = [c[0] for c in cursor.description]
    expected = set(cursor.fetchall())
    assert {tuple(r) for r in catalog.op13_hard_negatives(spark, str(tmp_path)).select(*columns).collect()} == expected and expected
