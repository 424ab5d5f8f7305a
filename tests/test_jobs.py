"""Table jobs against brute force on small rows."""

import random

from pyspark.sql import functions as F

from fairlead import schemas
from fairlead.operators import discover as ds, enrich as en, facts as fx, history as hs, matching as mt, ordered, pages as pg, search as sr
from fairlead.streaming import jobs

PAGE = """<html><head><title>Old</title><meta property="og:site_name" content="Harbour Trust"></head><body>
<nav>menu <a href="/home">Home</a></nav><h1>Harbour Security Fellowship 2027</h1><p>Location: Oslo, Norway</p>
<h2>Who can apply</h2><ul><li>You must be older than 21.</li><li>Open to African women only.</li>
<li>Applicants need at least three years of security experience.</li></ul>
<h2>Key dates</h2><dl><dt>Applications open</dt><dd>March 1, 2027</dd><dt>Applications close</dt><dd>2027-04-30</dd><dt>Training begins</dt><dd>June 2nd, 2027</dd></dl>
<h2>Benefits</h2><p>Flights are covered. Accommodation is not provided. A stipend of EUR 1,500.50 monthly.</p>
<h2>How to apply</h2><p>No application fee. Submit a CV and cover letter.</p><a href="apply?id=1">Apply now</a><script>var x = "<p>no</p>";</script></body></html>"""
LISTING = """<html><body><h1>Scholarships 2027</h1><article><h2>One Scholarship</h2><a href="/1">View</a></article>
<article><h2>Two Scholarship</h2></article><article><h2>Three Grant</h2></article></body></html>"""
JOB = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Cloud Intern","validThrough":"2027-05-01T00:00",
"hiringOrganization":{"name":"Cloudy"},"jobLocationType":"TELECOMMUTE","qualifications":"Current undergraduate student."}]}</script>
<script type="application/ld+json">{broken</script></head><body><h1>Role</h1></body></html>"""


def _pages(spark):
    rows = [("https://h.example/f", PAGE), ("https://h.example/list", LISTING), ("https://h.example/job", JOB)]
    return spark.createDataFrame(rows, "url string, html string").withColumn("fetched_at", F.lit("2027-03-10 00:00:00").cast("timestamp"))


def test_extraction(spark):
    features = pg.page_features(_pages(spark)).cache()
    table = {r.final_url.rsplit("/", 1)[1]: r for r in fx.extraction_table(features).collect()}
    f = table["f"]
    assert (f.title, f.organization, f.category, f.status) == ("Harbour Security Fellowship 2027", "Harbour Trust", "Fellowship", "open")
    assert (str(f.opening_date), str(f.deadline), str(f.program_start_date)) == ("2027-03-01", "2027-04-30 23:59:59", "2027-06-02")
    e = f.eligibility
    assert (e.minimum_age, e.minimum_age_exclusive, e.regions_allowed, e.gender_requirements, e.minimum_years_experience) == (21, True, ["Africa"], ["woman"], 3.0)
    assert (f.funding.flights.status, f.funding.accommodation.status, f.funding.stipend, f.funding.paid) == ("covered", "not_covered", "EUR 1,500.50 monthly", True)
    assert (f.application.application_fee, f.application.cv_required, f.country, f.city) == (False, True, "Norway", "Oslo")
    assert f.application_url == "https://h.example/apply?id=1" and "menu" not in f.text and "Applications close | 2027-04-30" in f.text
    assert table["list"].shape == "multi_opportunity_listing" and table["list"].reject_kind == "not_opportunity_page"
    job = table["job"]
    assert (job.title, job.organization, job.participation_mode, str(job.deadline)) == ("Cloud Intern", "Cloudy", "remote", "2027-05-01 23:59:59")
    opps, rejects = fx.extract(features)
    assert opps.count() == 2 and rejects.count() == 1 and fx.evidence_violations(opps).count() == 0


def test_ranked_spans_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else "k%d" % (i % 5), rng.randint(0, 3), i) for i in range(400)]
    got = ordered.ranked(spark.createDataFrame(rows, "k string, s int, i int").repartition(7), ["k"], [F.col("s"), F.col("i")]).collect()
    expected = {}
    for k in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            expected[r[2]] = n
    assert {r.i: r.rank for r in got} == expected


def test_change_history(spark):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("a", 9, None), ("a", 10, None), ("b", 4, "z")]
    done = hs.change_track(spark.createDataFrame(rows, "k string, seq long, v string"), "k", "seq", ["v"], width=2)
    got = {(r.k, r.seq): (r.change_class, r.version_number) for r in done.collect()}
    assert got == {("a", 1): ("new", 1), ("a", 2): ("known_unchanged", 1), ("a", 3): ("changed", 2), ("a", 9): ("changed", 3),
                   ("a", 10): ("known_unchanged", 3), ("b", 4): ("new", 1)}


def _walk(cands, max_pages):
    """Plain sequential walk with the same rules."""
    seen, visited, recorded, per_source, total = set(), set(), set(), {}, 0
    for c in sorted(cands, key=lambda c: c["seq"]):
        if c["depth"] == 2 and c["parent"] not in visited or c["url"] in seen:
            continue
        seen.add(c["url"]); recorded.add(c["seq"])
        if not (c["eligible"] and c["loadable"]) or per_source.get(c["source_no"], 0) >= c["cap"] or total >= max_pages:
            continue
        per_source[c["source_no"]] = per_source.get(c["source_no"], 0) + 1
        total += 1
        visited.add(c["seq"])
    return recorded, visited


def test_discovery_equals_sequential_walk(spark):
    rng = random.Random(7)
    cands = []
    for s in range(4):
        for p in range(5):
            hub = rng.random() < 0.5
            base = dict(source_no=s, eligible=rng.random() < 0.8, loadable=rng.random() < 0.9, cap=3)
            cands.append(dict(base, seq=(s, p, -1), depth=1, parent=(-1, -1, -1), url=f"u{rng.randint(0, 25)}", hub=hub))
            for c in range(3 if hub else 0):
                cands.append(dict(base, seq=(s, p, c), depth=2, parent=(s, p, -1), url=f"u{rng.randint(0, 25)}", hub=False, eligible=True, loadable=True))
    schema = ("run_id int, source_no int, seq struct<a:int,b:int,c:int>, depth int, parent_seq struct<a:int,b:int,c:int>, url string, eligible boolean,"
              "loadable boolean, is_hub boolean, max_links int, pinned boolean")
    rows = [(1, c["source_no"], c["seq"], c["depth"], c["parent"], c["url"], c["eligible"], c["loadable"], c["hub"], c["cap"], False) for c in cands]
    done = ds.settle_visits(spark.createDataFrame(rows, schema), max_pages=8).collect()
    # a depth-1 page that is no hub opens no children, so only hubs matter as parents
    recorded, visited = _walk([c for c in cands if c["depth"] == 1 or any(p["seq"] == c["parent"] and p["hub"] for p in cands)], 8)
    assert {tuple(r.seq) for r in done} == recorded
    assert {tuple(r.seq) for r in done if r.visited} == visited


def test_concepts_find_aliases_and_long_phrases(spark):
    long = "one two three four five six seven eight nine ten"
    texts = spark.createDataFrame([("o1", f"We use AppSec and {long}."), ("o2", "One two three four five six seven eight NOT nine; happy sec")], "opportunity_key string, text string")
    phrases = mt.concept_phrases(spark.createDataFrame([("application security",), (long,), ("app",)], "concept string"))
    got = {(r.opportunity_key, r.concept) for r in mt.text_concepts(texts, phrases, "opportunity_key", "text").collect()}
    assert got == {("o1", "application security"), ("o1", long)}


def test_json_leaves_any_depth(spark):
    body = '{"a":["x",{"b":"y \\"q\\"","c":[["z"]]}],"n":1}'
    assert spark.range(1).select(mt.json_leaves(F.lit(body)).alias("v")).first().v == ["x", 'y "q"', "z"]


def test_payload_rank_counts_dropped_items(spark):
    body = '{"results":[{"url":"https://a.example"},{"title":"T","url":"https://b.example","content":"c"},{"title":"M","url":"mailto:x"}]}'
    rows = sr.normalize_search_payload(spark.createDataFrame([("q", body)], "q string, body string"), "q", "body").collect()
    assert [(r.title, r.rank, r.snippet) for r in rows] == [("T", 2, "c")]


def test_override_logs_and_rejects(spark):
    opps = schemas.conform(spark.createDataFrame([("k", "T", "https://a.example/x/")], "opportunity_key string, title string, source_url string"), schemas.OPPORTUNITY)
    leaves = spark.createDataFrame([("https://A.example/x", "funding.flights.status", '"covered"'), ("https://a.example/x", "bad", "1")], "url string, path string, value string")
    row = en.apply_overrides(opps, leaves, "f.json").first()
    assert row.funding.flights.status == "covered" and [(o.field, o.previous_value) for o in row.manual_overrides] == [("funding.flights.status", "unknown")]
    assert en.override_rejects(leaves).count() == 1


def test_streamed_batches_match_one_batch(spark, tmp_path):
    rows = [("a", 1, "x"), ("b", 2, "y"), ("a", 3, "x"), ("a", 4, "z"), ("b", 5, "y"), ("c", 6, "w")]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    step = jobs.change_batches(str(tmp_path), "k", "seq", ["v"], buckets=16)
    step(df.where("seq <= 3"), 0)
    step(df.where("seq > 3"), 1)
    step(df.where("seq > 3"), 1)  # a replayed batch changes nothing
    step(df.limit(0), 2)
    more = spark.createDataFrame([("a", 7, "z"), ("a", 8, "x")], df.schema)
    step(more, 3)
    got = {(r.k, r.seq, r.version_number) for r in spark.read.parquet(f"{tmp_path}/versions").collect()}
    whole = {(r.k, r.seq, r.version_number) for r in hs.versions(hs.change_track(df.unionByName(more), "k", "seq", ["v"])).collect()}
    assert got == whole
    assert len(list((tmp_path / "state" / "batch=3").glob("key_bucket=*"))) == 1  # one key, one bucket


def test_late_rows_are_told_by_the_watermark_of_earlier_batches(spark, tmp_path):
    batches = [
        [("a", 10, "p"), ("a", 10, "o"), ("b", 5, "p"), (None, 9, "p")],
        [("a", 10, "q"), ("b", 7, "p"), ("c", 8, "p"), (None, 9, "q"), (None, 9, "p"), ("d", None, "p"), ("e", 30, "p")],
        [],
        [("e", 30, "q"), ("e", 28, "p"), ("c", 8, "p"), ("f", 29, "p")],
        [("f", 29, "p"), ("f", 27, "p")],
    ]
    kept, late, top, seen = set(), [], None, set()
    step = jobs.late_split(str(tmp_path), ["k"], "at", "v", "2 days")
    day = F.timestamp_seconds(F.col("d") * 86400).alias("at")
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, d long, v string").select("k", day, "v")
        step(df, number)
        step(df, number)
        old = [r for r in rows if r[1] is None or top is not None and r[1] < top - 2]
        late += [(number, *r) for r in old]
        for k, d, v in sorted((r for r in rows if r not in old), key=lambda r: r[2]):
            if (k, d) not in seen:
                seen.add((k, d))
                kept.add((number, k, d, v))
        top = max([r[1] for r in rows if r[1] is not None] + ([] if top is None else [top]), default=None)
    days = F.expr("cast(unix_seconds(at) div 86400 as long)").alias("d")
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").select("batch", "k", days, "v").collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(read("kept"), key=key) == sorted(kept, key=key)
    assert sorted(read("late"), key=key) == sorted(late, key=key)
