"""End-to-end plans on a few pages."""

from pyspark.sql import functions as F

from fairlead import schemas
from fairlead.operators import pages as pg
from fairlead.plans import daily, evaluate
from tests.test_jobs import LISTING, PAGE


def _profile(spark):
    identity, education = schemas.PROFILE["identity"].dataType, schemas.PROFILE["education"].dataType
    return spark.range(1).select(
        F.lit("p1").alias("profile_id"),
        schemas.fill(identity, nationality=F.array(F.lit("Kenya")), residence=F.create_map(F.lit("country"), F.lit("Ghana")),
                     age=schemas.fill(identity["age"].dataType, current=F.lit(30)), gender=F.lit("Woman")).alias("identity"),
        schemas.fill(education, university=F.lit("U"), degree=F.lit("BSc"), graduation_year=F.lit(2027),
                     current_stage=schemas.fill(education["current_stage"].dataType, year=F.lit(1))).alias("education"),
        schemas.fill(schemas.PROFILE["professional_identity"].dataType, primary=F.array(F.lit("security"))).alias("professional_identity"),
        F.from_json(F.lit('[{"organization":"O","role":"Security Analyst","start_date":"2020-01","end_date":"2023-12"},'
                          '{"organization":"Q","role":"Tester","start_date":"2022-06"}]'), schemas.PROFILE["experience"].dataType).alias("experience"),
        F.array().cast(schemas.PROFILE["projects"].dataType).alias("projects"),
    )


def _snapshots(spark):
    rows = [("https://h.example/f", PAGE, 200), ("https://h.example/list", LISTING, 200), ("https://h.example/gone", PAGE, 404)]
    return spark.createDataFrame(rows, "url string, html string, status_code int").withColumn("fetched_at", F.lit("2027-03-10").cast("timestamp"))


def test_evaluate_isolates_failures(spark):
    as_of = F.to_date(F.lit("2027-03-10"))
    pairs = spark.createDataFrame([("p1", "https://h.example/f"), ("p1", "https://h.example/list")], "profile_id string, u string").select(
        "profile_id", F.sha2("u", 256).alias("opportunity_key")
    )
    out = evaluate.run(_snapshots(spark), pairs, _profile(spark), as_of)
    row = out["assessments"].first()
    assert row.eligibility_status == "eligible" and row.total_score == sum(
        getattr(row, f"{n}_score").score for n in ("eligibility", "relevance", "value", "feasibility", "timing", "friction", "confidence")
    )
    assert sorted(r.stage for r in out["failures"].collect()) == ["extract", "fetch"]


def test_search_run_to_outbox(spark):
    features = pg.page_features(pg.admit_pages(_snapshots(spark))[0])
    profiles = _profile(spark)
    seen = F.lit("2027-03-10 00:00:00").cast("timestamp")
    from fairlead.operators import search as sr
    first = sr.query_plan(profiles, F.to_date(seen), sr.MAX_QUERIES, focuses=sr.FOCUSES).where("query_no = 0").first().text
    recorded = spark.createDataFrame([
        ("Fellowship", "https://h.example/f?utm_source=x", "Apply by 2027", 1, first, "web", 0), ("List", "https://h.example/list", "", 2, first, "web", 1),
        ("Lost", "https://h.example/lost", "grant", 3, first, "web", 2),
    ], "title string, url string, snippet string, rank int, query string, provider string, seq long")
    run = daily.search_run(profiles, recorded, features, F.to_date(seen), seen, max_queries=sr.MAX_QUERIES)
    shapes = {r.canonical.rsplit("/", 1)[1]: (r.page_shape, r.proceeded_to_extraction) for r in run["candidates"].collect()}
    assert shapes == {"f": ("specific_opportunity", True), "list": ("multi_opportunity_listing", False), "lost": (None, None)}
