import corpus_pipeline
from fairlead.llm import toxicity
from tests.llm.helpers import SF, brute_components, brute_removed, documents, odd_documents


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after_df = stage(spark, docs, SF)
        assert after_df.columns == docs.columns
        rows = [tuple(r) for r in after_df.collect()]
        after = {r[0]: r[1] for r in rows}
        assert set(after) <= set(before) and len(after) == len(rows)
        if name == "ngram_join":
            assert set(after) == {i for i, (_, c) in brute_components(before.items()).items() if i == c}
        elif name == "repeats":
            removed = brute_removed(list(before.items()))
            assert after == {i: bytes(b for b, m in zip(data, mask) if not m).decode("utf-8", "ignore") for i, (mask, data) in removed.items()}
            assert all(r[4] == len(r[1]) for r in rows)
        else:
            assert len(after) > 0.7 * len(before)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r[0] for r in rows} <= set(start)


def test_run_is_the_stages_one_after_another(spark):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == columns and df.count() > 0


def test_odd_rows(spark):
    docs = documents(spark, odd_documents() + [(30 + i, f"an idiot {i} and some text of them") for i in range(5)]).selectExpr("*", "if(doc_id < 9, 'en', null) AS lang")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert toxicity.SAMPLE > 0
