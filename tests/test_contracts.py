"""Foreign providers and assessors, malformed inputs."""

import json
from datetime import datetime, timezone

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fairlead.catalog import ORACLE, QUERIES
from fairlead.operators import assess as av, contracts as ct
from fairlead.plans import evaluate
from fairlead.sources import readers
from fairlead.sources.bindings import TABLES
from tests.test_jobs import LISTING, PAGE
from tests.test_plans import _profile

SF = "/root/testdata/sf0.001"
LONG = "Harbour Fellowship\nApply by 30 April 2027 at https://h.example/apply or write to the office of the harbour."


@pytest.mark.parametrize("name", ["fact_provider", "judgement_contract", "profile_rejects", "recorded_hits"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = con.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    assert sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect()) == expected and len(set(x.split(",")[-1] for x in expected)) > 2


def _asked(spark, *texts):
    rows = [(i, f"https://h.example/{i}?utm_source=x", f"https://h.example/{i}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_key int, requested_url string, final_url string, cleaned_text string").withColumn("fetched_at", F.lit("2027-03-10").cast("timestamp"))


def test_provider_answers_become_records(spark):
    def provider(text, url):
        return {
            "title": "  Harbour Fellowship ", "deadline": datetime(2027, 4, 30, 23, 59, 59, tzinfo=timezone.utc), "application_url": "/apply", "rolling_application": True,
            "evidence": [
                {"field": "deadline", "value": "2027-04-30", "evidence_text": "apply BY  30 april 2027"},
                {"field": "application_url", "value": "apply", "evidence_text": "https://h.example/apply", "source_url": "https://h.example/apply", "confidence": "high"},
            ],
        }

    good, bad = ct.provided_facts(_asked(spark, LONG, None, " ", LONG[:40]), provider)
    row = good.first()
    assert (row.title, row.status, row.category, row.extraction_confidence, row.participation_mode) == ("Harbour Fellowship", "open", "Unknown", "medium", "unknown")
    assert [e.confidence for e in row.evidence] == ["medium", "high"] and row.evidence[0].source_url == "https://h.example/0" and row.subcategories == []
    assert good.count() == 1 and sorted((r.page_key, r.reason) for r in bad.collect()) == [(i, "insufficient_cleaned_content") for i in (1, 2, 3)]
    assert [d.count() for d in ct.provided_facts(_asked(spark, LONG).limit(0), provider)] == [0, 0]


BREACHES = [
    ({}, "response: no title"), (None, "response:"), ({"title": "T", "colour": "red"}, "response: unknown fields"), ({"title": ["T"]}, "response:"),
    ({"title": "T", "official_url": "https://other.example/"}, "ungrounded: a URL"), ({"title": "T", "extraction_confidence": "sure"}, "response: unknown confidence"),
    ({"title": "T", "evidence": [{"field": "x", "value": "y", "evidence_text": "not there"}]}, "ungrounded: evidence"),
    ({"title": "T", "evidence": [{"field": "x", "value": "y", "evidence_text": " "}]}, "ungrounded: evidence"),
    ({"title": "T", "evidence": [{"field": "x", "evidence_text": "office"}]}, "response: evidence without"),
    ({"title": "T", "geographic_restrictions": ["Kenya"]}, "unproven: hard eligibility"), ({"title": "T", "funding": {"stipend": "EUR 5"}}, "unproven: stipend"),
]


def test_each_breach_is_a_failure(spark):
    answers = [a for a, _ in BREACHES]
    good, bad = ct.provided_facts(_asked(spark, *[LONG] * len(BREACHES)), lambda text, url: answers[int(url.rsplit("/", 1)[1])])
    found = {r.page_key: r.reason for r in bad.collect()}
    assert good.count() == 0 and len(found) == len(BREACHES)
    assert [(i, found[i]) for i, (_, reason) in enumerate(BREACHES) if not found[i].startswith(reason)] == []


def test_a_provider_and_an_assessor_in_the_plan(spark):
    rows = [("https://h.example/f", PAGE), ("https://h.example/list", LISTING)]
    pages = spark.createDataFrame(rows, "url string, html string").withColumn("status_code", F.lit(200)).withColumn("fetched_at", F.lit("2027-03-10").cast("timestamp"))
    pairs = spark.createDataFrame([("p1", u) for u, _ in rows], "profile_id string, u string").select("profile_id", F.sha2("u", 256).alias("opportunity_key"))

    def provider(text, url):
        if "Harbour" not in text:
            raise LookupError("nothing here")
        return {"title": "Harbour Security Fellowship 2027", "category": "Fellowship", "evidence": []}

    def assessor(pairs, opps, profiles):
        return av.judge(pairs, opps, profiles).drop("concerns").withColumn("timing_level", F.lit("closing_soon"))

    out = evaluate.run(pages, pairs, _profile(spark), F.to_date(F.lit("2027-03-10")), assessor=assessor, facts=evaluate.facts_by(provider))
    row = out["assessments"].first()
    assert (row.timing_score.score, row.title) == (6, "Harbour Security Fellowship 2027")
    assert [r.stage for r in out["failures"].collect()] == ["extract"]
    wrong = evaluate.run(
        pages, pairs, _profile(spark), F.to_date(F.lit("2027-03-10")), facts=evaluate.facts_by(provider),
        assessor=lambda p, o, f: assessor(p, o, f).withColumn("value_level", F.lit("huge")),
    )
    assert wrong["assessments"].count() == 0 and {r.reason for r in wrong["failures"].collect() if r.stage == "evaluate"} == {"value_level is not a level"}


def test_broken_lines_and_items_are_rejects(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"profile_id":"a","mood":1}\n{broken\n\n7\n[]\n{"identity":{}}\n')
    good, bad = readers.load_profiles(spark, str(tmp_path / "p.jsonl"))
    assert sorted(len(r.profile_id) for r in good.collect()) == [1, 64] and [json.loads(r.extra).get("mood") for r in good.where("profile_id = 'a'").collect()] == [1]
    assert sorted(r.line for r in bad.collect()) == ["7", "[]", "{broken"]
    (tmp_path / "hits").mkdir()
    (tmp_path / "hits" / "a.json").write_text('[{"title":"T","url":"https://x.example","rank":1}, 5, {"title":"U"}, null]')
    (tmp_path / "hits" / "b.json").write_text('{"title":"T","url":"https://x.example","rank":1}')
    good, bad = readers.scan_search_results(spark, str(tmp_path / "hits"))
    assert [r.title for r in good.collect()] == ["T"] and sorted((r.seq % readers.FILE_ROOM, r.reason) for r in bad.collect()) == [
        (0, "not a JSON list"), (1, "no title or URL"), (2, "no title or URL"), (3, "no title or URL")]


def test_pages_are_dealt_to_the_provider(spark):
    pages = spark.createDataFrame([(n, "https://h.example/p", "https://h.example/p", LONG, datetime(2027, 1, 1)) for n in range(8)],
                                  "page_key long, requested_url string, final_url string, cleaned_text string, fetched_at timestamp").coalesce(1)
    seen = []

    def ask(asked, provider):
        seen.append(asked._jdf.queryExecution().optimizedPlan().toString())
        return ct.answers(asked, provider)

    good, bad = ct.provided_facts(pages, lambda text, url: {"title": "Harbour"}, ask)
    assert "RepartitionByExpression" in seen[0] and good.count() == 8 and bad.count() == 0


def test_answers_field_by_field_are_the_answers_as_a_whole():
    layout = to_arrow_schema(T.StructType([ct._ANSWER["result"]])).field(0).type
    kinds = {f.name: f.type for f in layout}
    note = {"field": "deadline", "value": "x", "source_url": None, "confidence": None, "evidence_text": "y"}
    rows = [None, {"title": "a", "evidence": [note]}, {"title": "b", "evidence": [list(note.items())]}, {}, {"title": None, "rolling_application": True}]
    assert ct._results([r and ct._fitted(r, kinds, layout) for r in rows], layout).equals(pa.concat_arrays([pa.array([r], layout) for r in rows]))
    for broken in ({"opening_date": "soon"}, {"title": 3}, {"evidence": 4}):
        with pytest.raises((pa.ArrowException, TypeError)) as mine:
            ct._fitted(broken, kinds, layout)
        with pytest.raises((pa.ArrowException, TypeError)) as whole:
            pa.array([broken], layout)
        assert str(mine.value) == str(whole.value)
