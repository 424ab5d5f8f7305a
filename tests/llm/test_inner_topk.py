import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import inner_topk


def brute(rows, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, qv in {i: v for i, v in vectors if i % 10 == 0}.items():
        best = {}
        for i, v in vectors:
            if i != q:
                score = sum(a * b for a, b in zip(qv, v))
                best[i] = max(best.get(i, score), score)
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, s))
    return out


def run(spark, rows, k):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = df.where(F.col("vec_id").isNotNull() & inner_topk.usable(F.col("embedding"))).select("vec_id", inner_topk.whole_steps(F.col("embedding"), 1024).alias("v"))
    found = inner_topk.search(v, v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), k)
    return {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()}


def test_against_brute_force_with_ties_and_gaps(spark, monkeypatch):
    for name, value in (("SLICE", 40), ("QUERIES", 8), ("HEAD", 30)):
        monkeypatch.setattr(inner_topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.01, 0.3, 2.0])).astype("f4").tolist()) for i in range(260)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]  # copies: ties go to the smaller id
    rows += [(400, None), (401, [1.0, None, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [1.0] * 6), (404, []), (405, [0.0] * 6), (406, [3.0, 1.0])]
    assert run(spark, rows, 10) == brute(rows, 10)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5])]
    assert run(spark, rows, 10) == brute(rows, 10)
    assert run(spark, [], 10) == set()
    assert run(spark, [(3, [1.0])], 10) == set()


@pytest.mark.parametrize("odd", [None, [1.0, None], [float("nan"), 1.0], [float("-inf"), 1.0]], ids=["null", "null component", "nan", "infinite"])
def test_each_kind_of_unusable_vector_alone(spark, odd):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(70, odd)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_one_id_on_many_rows(spark, monkeypatch):
    for name, value in (("SLICE", 16), ("QUERIES", 2), ("HEAD", 8)):
        monkeypatch.setattr(inner_topk, name, value)
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(61, [float(i % 9), 2.0, float(i % 4)]) for i in range(40)]
    assert run(spark, rows, 4) == brute(rows, 4)
