import json

from pyspark.sql import functions as F

from fairlead.sources import readers, sinks


def _source(id, **other):
    return {"id": id, "name": "n", "url": "https://a.example/x", "source_type": "job_board"} | other


def test_url_list_keeps_bad_lines_as_rejects(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("https://a.example/1\n\n   \n  http://b.example/2 \nftp://c.example\nwords\nhttps://\n")
    good, bad = readers.read_url_list(spark, str(tmp_path / "urls.txt"))
    assert sorted(r["url"] for r in good.collect()) == ["http://b.example/2", "https://a.example/1"]
    assert sorted(r["url"] for r in bad.collect()) == ["ftp://c.example", "https://", "words"]


def test_sources_and_their_rejects(spark, tmp_path):
    rows = [
        _source("a"), _source("b", max_links_per_run=7, enabled=False), _source("c", max_links_per_run=0), _source("d", max_links_per_run=101),
        _source("Bad Id"), _source(None), _source("twice"), _source("twice"), _source("e", source_type="blog"), _source("f", url="mailto:x@y.example"),
    ]
    path = tmp_path / "sources.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    good, bad = readers.read_sources(spark, str(path))
    assert {r["id"]: (r["max_links_per_run"], r["enabled"], r["check_frequency"]) for r in good.collect()} == {"a": (None, True, "daily"), "b": (7, False, "daily")}
    assert sorted((r["id"] or "", r["reason"]) for r in bad.collect()) == [
        ("", "invalid source id"), ("Bad Id", "invalid source id"), ("c", "link cap out of range"), ("d", "link cap out of range"),
        ("e", "unknown source type"), ("f", "not a web URL"), ("twice", "source id is not unique"), ("twice", "source id is not unique"),
    ]
    assert {r["id"]: r["max_links_per_run"] for r in readers.read_sources(spark, str(path), 20)[0].collect()} == {"a": 20, "b": 7}


def test_a_rerun_replaces_its_own_run_only(spark, tmp_path):
    for run, n in (("one", 3), ("two", 2), ("one", 5)):
        sinks.write_run({"items": spark.range(n), "failures": spark.range(0)}, str(tmp_path), run)
    counts = spark.read.parquet(str(tmp_path / "items")).groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in counts} == {"one": 5, "two": 2}
    assert spark.read.parquet(str(tmp_path / "failures" / "run_id=one")).count() == 0


def test_appended_candidates_keep_earlier_ones(spark, tmp_path):
    for day in ("1", "2", "2"):
        sinks.append_candidates(spark.range(2).withColumn("day", F.lit(day)), str(tmp_path / "log"), ("day",))
    assert {r["day"]: r["count"] for r in spark.read.parquet(str(tmp_path / "log")).groupBy("day").count().collect()} == {1: 2, 2: 4}


def test_new_sources_replace_old_rows_of_their_id(spark):
    old = spark.createDataFrame([("a", "https://a.example/old", "x"), ("b", "https://b.example/", "y")], "id string, url string, notes string").withColumn("last_checked_at", F.lit("mon"))
    new = spark.createDataFrame([("a", "https://A.example/new#part"), ("c", "https://c.example/")], "id string, url string")
    rows = {r["id"]: (r["url"], r["notes"], r["last_checked_at"]) for r in sinks.upsert_sources(old, new, F.lit("tue")).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["b"] == ("https://b.example/", "y", "mon")
    assert rows["a"][0] == "https://a.example/new" and rows["a"][1:] == (None, "tue") and rows["c"][2] == "tue"


def test_ledger_folds_attempts(spark):
    layout = "k string, attempts int, first_sent_at string, last_sent_at string, last_attempted_at string, delivery_status string, error string"
    old = spark.createDataFrame([("a", 2, "1", "1", "2", "failed", "e"), ("b", 1, None, None, "1", "failed", "e")], layout)
    new = spark.createDataFrame([("a", 1, "3", "3", "3", "sent", None), ("b", 1, "4", "4", "4", "sent", None), ("c", 1, None, None, "5", "failed", "f")], layout)
    rows = {r["k"]: tuple(r)[1:] for r in sinks.upsert_ledger(old, new, ["k"]).collect()}
    assert rows["a"] == (3, "1", "3", "3", "sent", None)
    assert rows["b"] == (2, "4", "4", "4", "sent", None)
    assert rows["c"] == (1, None, None, "5", "failed", "f")
