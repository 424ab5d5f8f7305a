import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.llm import catalog, whitening

NAN, INF = float("nan"), float("inf")


def brute(x, k):
    """Distinct rows, deviations of all rows, whitened rows up to sign, shares of the trace."""
    x = np.array(x, np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    return n, ((n * x - sums) ** 2).sum(1), ((n * x - sums) / n) @ axes[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def run(spark, vectors, k):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, x array<long>")
    model = whitening.fit(rows, k)
    out = whitening.whiten(rows, model).orderBy("vec_id").collect()
    return model, np.array([r["deviation"] for r in out]), np.array([r["whitened"] for r in out])


def compare(spark, vectors, k):
    n, deviation, whitened, share = brute(vectors, k)
    model, got_deviation, got = run(spark, vectors, k)
    assert model.n == n and (got_deviation == deviation).all() and got.shape == whitened.shape
    assert np.allclose(got * np.sign((got * whitened).sum(0)), whitened, atol=1e-9)
    assert np.allclose(model.values / model.trace, share, rtol=1e-9) and model.identity_error < 1e-9
    return model


def test_far_from_zero_with_copies_and_a_block_smaller_than_the_width(spark, monkeypatch):
    monkeypatch.setattr(whitening, "EXTRA", 4)
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(300, 20)) * np.linspace(40, 5, 20)).astype(int) + 1_000_000_000
    passes = []
    once = whitening.Spread.times
    monkeypatch.setattr(whitening.Spread, "times", lambda self, q: passes.append(q.shape) or once(self, q))
    model = compare(spark, [*x.tolist(), *x[:1].tolist() * 150], 3)
    assert model.n == 300 and set(passes) == {(20, 7)} and len(passes) > whitening.DEGREE


def test_sums_of_many_tasks_are_added_up_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ENTRIES", 20)
    monkeypatch.setattr(whitening, "GATHERED", 1)
    x = np.floor(np.random.default_rng(6).normal(size=(200, 6)) * 50).astype(int)
    compare(spark, x.tolist(), 2)


def test_fewer_dimensions_than_components_and_flat_ones(spark):
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(80, 3)) * 50).astype(int)
    compare(spark, np.column_stack([x, x[:, 0] * 2, np.full(80, 7)]).tolist(), 16)  # rank three of five


def test_the_residual_is_not_reached(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 1)
    monkeypatch.setattr(whitening, "EXTRA", 1)
    x = np.floor(np.random.default_rng(3).normal(size=(60, 12)) * 50).astype(int)
    with pytest.raises(whitening.NotCertified):
        whitening.fit(spark.createDataFrame([(v,) for v in x.tolist()], "x array<long>"), 2)


def test_one_vector_has_no_components_and_no_rows_no_fit(spark):
    one = spark.createDataFrame([([1, 2],), ([1, 2],)], "x array<long>")
    assert len(whitening.fit(one).values) == 0
    assert whitening.fit(one.limit(0)) is None


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=4).tolist(), 1, "x") for i in range(40)]
    odd = [(50, None), (51, [1.0, None, 0.0, 0.0]), (52, [NAN] * 4), (53, [0.0, INF, 0.0, 0.0]), (None, [0.5] * 4), (None, [0.5] * 4), (54, [0.25, 0.5])]
    rows = good + [(i, v, None, None) for i, v in odd]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.op11_whitening(spark, str(tmp_path)).collect()
    kept = [v for _, v, *_ in good] + [[0.5] * 4] * 2 + [[0.25, 0.5, 0.0, 0.0]]
    n, deviation, _, share = brute(np.floor(64 * np.array(kept, "f4").astype(float)).astype(int) + 1_000_000, 16)
    assert len(got) == 4 * len(kept) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3, 4}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviation.tolist())
    assert np.allclose(sorted({r["explained"] for r in got}), sorted(share))
    assert sum(r["vec_id"] is None for r in got) == 8
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert catalog.op11_whitening(spark, f"{tmp_path}/none").count() == 0


def test_steps(spark):
    c = spark.createDataFrame([([-0.01, 0.5, 1.999],)], "c array<float>").select(whitening.whole_steps(F.col("c"), 64, 1_000_000).alias("x"))
    assert c.first()["x"] == [999_999, 1_000_032, 1_000_127]
