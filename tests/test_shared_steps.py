"""Steps that several facts share are worked out once a page."""

import re

from pyspark.sql import functions as F

from fairlead.catalog import QUERIES
from fairlead.functions import text as tx
from fairlead.operators import facts as fx, matching as mt, notify as nt, pages as pg
from fairlead.sources import readers


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_prepared_once_for_all_costs(spark):
    df = spark.createDataFrame([("Flights are covered. Meals are not provided. Hotel.",)], "text string")
    lines = df.select(fx.cost_lines(tx.sentences(F.col("text"))).alias("l"), fx.lists_package(F.col("text")).alias("p"))
    out = lines.select(*[fx.coverage(F.col("l"), F.col("p"), nouns).alias(n) for n, nouns in fx.vocab.COVERAGE_NOUNS.items()])
    row = out.first()
    assert (row.flights.status, row.meals.status, row.accommodation) == ("covered", "not_covered", None)
    assert row.flights.notes == row.flights.snippet == "Flights are covered."
    packed = df.select(fx.coverage(fx.cost_lines(F.array(F.lit("A hotel"))), F.lit(True), ("hotel",)).alias("c")).first().c
    assert (packed.status, packed.snippet) == ("covered", "A hotel") and packed.notes != "A hotel"


def test_sections_and_dates_do_not_grow_with_their_uses(spark):
    df = spark.createDataFrame([([(0, "h2", "Who"), (1, "p", "a"), (2, "h2", "Who"), (3, "p", "b")],)], "nodes array<struct<pos:int,tag:string,text:string>>")
    listed = df.select(pg.section_list(F.col("nodes")).alias("s"))
    assert [(s.name, s["items"]) for s in listed.first().s] == [("who", ["b"])]
    assert _plan(listed).count("IN (h1,h2,h3,h4,h5,h6,p,li,tr,dt)") <= 2
    dated = spark.createDataFrame([("until May 4th, 2026",)], "t string").select(fx.dt.parse_date(F.col("t")).alias("d"))
    assert str(dated.first().d) == "2026-05-04"
    assert _plan(dated.where("rand() > -1")).count("(?iU)") == 1


def test_recorded_items_do_not_carry_their_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"title":"T","url":"https://h.example/","rank":1}, {"title":"T"}]')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = readers.scan_search_results(spark, str(tmp_path))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["no title or URL", "not a JSON list"]
    plan = good._jdf.queryExecution().executedPlan().toString()
    kept = re.search(r"Generate posexplode\(.*\), \[([^\]]*)\], false", plan)[1]
    assert "value" not in kept and "r#" not in kept and "items" not in kept


def test_items_are_ranked_on_the_columns_that_word_them(spark):
    columns = dict.fromkeys(nt._ITEM, "x") | {"seq": 1, "total_score": 5, "rolling_application": False, "deadline": None}
    planned = spark.createDataFrame([columns], "seq long, total_score int, deadline timestamp, rolling_application boolean, " + ", ".join(
        f"{c} string" for c in nt._ITEM if c not in ("seq", "total_score", "deadline", "rolling_application")
    )).select("*", F.lit("f").alias("fingerprint"), F.lit("new").alias("change_class"), F.lit("open").alias("status"), F.lit("p").alias("profile_id"), F.lit("wide").alias("other"))
    seen = []
    real = nt.ranked_plan
    nt.ranked_plan = lambda df, *a: seen.append(df.columns) or real(df, *a)
    try:
        header, items = nt.outbox(planned, keep=("profile_id",))
    finally:
        nt.ranked_plan = real
    assert seen == [[*nt._ITEM, "profile_id"]]
    assert items.first().profile_id == "p" and items.first().position == 1
    row = header.first()
    assert (row["items"], row.new, row.changed, row.closing_soon, row.severity) == (1, 1, 0, 0, "normal") and len(row.notification_fingerprint) == 64


def test_ngrams_are_made_in_dealt_texts_and_meet_every_phrase(spark, monkeypatch):
    long = "one two three four five six seven eight nine"
    phrases = ["a", "b c", long, long[:-4] + "ten", "", "c d e f g h i j"]
    words = ["", "a", "x b c y", long, "x " + long, "a b c d e f g h i j", "bc", "B-C, a"]
    texts = spark.createDataFrame([*enumerate(words), (None, "a"), (99, None), (1, "a")], "key long, text string").coalesce(1)
    named = spark.createDataFrame([(f"c{p}", p) for p in phrases] + [("again", "a"), ("none", None)], "concept string, phrase string")
    plain = lambda t: " " + " ".join(re.findall("[a-z]+", t.lower())) + " "
    expected = {(k, c) for k, t in [*enumerate(words), (None, "a")] for c, p in [(f"c{p}", p) for p in phrases] + [("again", "a")] if f" {p} " in plain(t)}
    for most in (200_000, 0):
        monkeypatch.setattr(mt, "SENT_PHRASES", most)
        found = mt.text_concepts(texts, named, "key", "text")
        assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(k, c) for k, c in expected if k is not None or c != long}
    few = mt.text_concepts(texts, named.where("length(phrase) < 4"), "key", "text")
    assert set(map(tuple, few.collect())) == {(k, c) for k, c in expected if len(c) < 5 or c == "again"}


def test_queries_of_text_or_elements_alone_make_no_whole_outline(spark):
    for name, made in (("money", "outline_text"), ("visited_class", "outline_nodes")):
        plan = _plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert f"{made}(" in plan and "outline(" not in plan
