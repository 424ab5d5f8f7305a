import numpy as np
from pyspark.sql import functions as F

from fairlead.llm import language
from fairlead.llm.catalog import QUERIES
from tests.llm.helpers import SF_BIG, documents, odd_documents


def test_held_out_accuracy_and_calibration(spark):
    truth = spark.read.parquet(f"{SF_BIG}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op3_language"](spark, SF_BIG).join(truth, "doc_id").where("held_out").collect()
    right = np.array([r["lang"] == r["lang_pred"] for r in rows])
    assert len(rows) > 200 and right.mean() > 0.97
    assert abs(np.mean([r["score"] for r in rows]) - right.mean()) < 0.05


def test_odd_inputs(spark):
    docs = documents(spark, odd_documents())
    none = language.predict(docs, language.learn(docs.where("false"), F.lit("en")))
    assert none.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    one = language.predict(docs, language.learn(docs, F.lit("en"))).collect()
    assert len(one) == docs.count()
    assert {r["doc_id"] for r in one if r["lang_pred"] == "und"} == {3, 4, 5}
    assert language.predict(docs.limit(0), language.learn(docs, F.lit("en"))).count() == 0


def test_equal_rows_get_equal_predictions_and_weights_are_sparse(spark):
    docs = documents(spark, odd_documents() + [(20 + i, "le chat est dans la maison " * (i + 1)) for i in range(20)])
    model = language.learn(docs, F.when(F.col("doc_id") >= 20, "fr").otherwise("en"))
    assert (model[2] == 0).mean() > 0.9
    found = {}
    for r in language.predict(docs, model).collect():
        found.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(x) == 1 for x in found.values())
    assert all(lang == "fr" for t, x in found.items() if t and t.startswith("le chat") for lang, _ in x)


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=language._softmax(r)) for r in z])
    assert 4 < language.temperature(z * 5, labels) < 6
