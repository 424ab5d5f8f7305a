"""Facts read back out of notice pages, and rules over notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead import vocab
from fairlead.catalog.base import query
from fairlead.functions import text as tx
from fairlead.operators import classify as cl, enrich as en, facts as fx, history as hs, pages as pg
from fairlead.sources import bindings as b

DAY = b.DUCK.text_date


def _features(spark, sf, *outlined):
    return pg.page_features(b.notice_pages(spark, sf), outlined or ("text", "nodes"))


def _units(spark, sf):
    return _features(spark, sf).select("notice_id", fx.dated_units(pg.units(F.col("nodes"), F.col("text"))).alias("u"))


@query("derive_status", b.with_views(f"""
    SELECT notice_id, CASE WHEN deadline < t THEN 'closed' WHEN deadline <= t + interval 7 day THEN 'closing_soon'
           WHEN opening_date > cast(t as date) THEN CASE WHEN year(opening_date) > year(t) THEN 'future_cycle' ELSE 'opening_soon' END
           WHEN deadline IS NOT NULL AND opening_date IS NOT NULL THEN 'open' WHEN rolling OR mode = 'remote' THEN 'open'
           WHEN mode = 'hybrid' THEN 'opening_soon' ELSE 'unknown' END AS status
    FROM notices, (SELECT timestamp '{b.AS_OF}' AS t)""", "notices"))
def derive_status(spark, sf):
    n = b.view(spark, sf, "notices")
    status = cl.derive_status(
        F.col("deadline"), F.col("opening_date"), F.lit(b.AS_OF).cast("timestamp"), F.col("rolling"),
        F.col("mode") == "remote", F.col("mode") == "hybrid",
    )
    return n.select("notice_id", status.alias("status"))


@query("category", b.with_views("""
    SELECT notice_id, CASE word WHEN 'Hackathon' THEN 'Hackathon / Competition' ELSE word END AS category FROM notices""", "notices"))
def category(spark, sf):
    n = b.view(spark, sf, "notices")
    return n.select("notice_id", cl.category(tx.norm_label(F.col("title")), F.lit(False)).alias("category"))


@query("labelled_date", b.with_views("SELECT notice_id, deadline_date AS deadline, opening_date AS opening FROM notices", "notices"))
def labelled_date(spark, sf):
    u = F.col("u")
    return _units(spark, sf).select(
        "notice_id", fx.labelled_date(u, vocab.DEADLINE_LABELS, vocab.DEADLINE_EXCLUSIONS)["day"].alias("deadline"),
        fx.labelled_date(u, vocab.OPENING_LABELS)["day"].alias("opening"),
    )


@query("app_window", b.with_views("""
    SELECT notice_id, CASE WHEN opening_date IS NOT NULL AND deadline_date IS NOT NULL AND (mode = 'remote' OR year(opening_date) = year(deadline_date)) THEN opening_date END AS opening,
           CASE WHEN opening_date IS NOT NULL AND deadline_date IS NOT NULL AND (mode = 'remote' OR year(opening_date) = year(deadline_date)) THEN deadline_date END AS deadline
    FROM notices""", "notices"))
def app_window(spark, sf):
    n = b.view(spark, sf, "notices")
    day = lambda c, f: F.date_format(c, f)
    line = F.when(F.col("mode") == "remote", F.concat(
        F.lit("Application period: "), day("opening_date", "yyyy-MM-dd"), F.lit(" until "), day("deadline_date", "MMMM d, yyyy")
    )).when(
        F.year("opening_date") == F.year("deadline_date"),
        F.concat(F.lit("Applications: "), day("opening_date", "MMMM d"), F.lit("th - "), day("deadline_date", "MMMM d, yyyy")),
    )
    window = fx.app_window(fx.dated_units(F.array(F.lit("Nothing here."), F.coalesce(line, F.lit("Applications: soon")))))
    return n.select("notice_id", window["opening"].alias("opening"), window["deadline"].alias("deadline"))


@query("date_range", b.with_views("""
    SELECT notice_id, opening_date AS first_day, CASE WHEN opening_date IS NOT NULL THEN deadline_date END AS last_day FROM notices""", "notices"))
def date_range(spark, sf):
    n = b.view(spark, sf, "notices")
    line = F.concat(F.lit("Programme dates: "), F.date_format("opening_date", "MMMM d, yyyy"), F.lit(" to "), F.coalesce(F.date_format("deadline_date", "MMMM d yyyy"), F.lit("later")))
    span = fx.date_range(fx.dated_units(F.array(F.lit("Orientation and programme dates: May 1, 2020"), F.coalesce(line, F.lit("no dates")))))
    return n.select("notice_id", span["first"].alias("first_day"), span["second"].alias("last_day"))


@query("money", b.with_views("""
    SELECT notice_id, stipend || ' per month' AS stipend, 'A stipend of ' || stipend || ' per month' AS snippet, cast(NULL as varchar) AS salary FROM notices""", "notices"))
def money(spark, sf):
    f = pg.page_texts(b.notice_pages(spark, sf), "notice_id")
    stipend = fx.money(F.col("text"), vocab.MONEY_LABELS["stipend"])
    return f.select(
        "notice_id", stipend["amount"].alias("stipend"), stipend["snippet"].alias("snippet"),
        fx.money(F.col("text"), vocab.MONEY_LABELS["salary"])["amount"].alias("salary"),
    )


@query("coverage", b.with_views("SELECT notice_id, flights, accommodation, 'unknown' AS meals FROM notices", "notices"))
def coverage(spark, sf):
    f = _features(spark, sf, "text").select(
        "notice_id", fx.cost_lines(tx.sentences(F.col("text"))).alias("lines"), fx.lists_package(F.col("text")).alias("package")
    )
    status = lambda name: fx.component(fx.coverage(F.col("lines"), F.col("package"), vocab.COVERAGE_NOUNS[name]))["status"].alias(name)
    return f.select("notice_id", *[status(n) for n in ("flights", "accommodation", "meals")])


@query("benefits", b.with_views("SELECT notice_id, 'Mentorship' AS label, 'Mentorship by staff.' AS snippet FROM notices", "notices"))
def benefits(spark, sf):
    f = _features(spark, sf, "text")
    return f.select("notice_id", F.explode(fx.benefits(tx.sentences(F.col("text")))).alias("x")).select("notice_id", "x.label", "x.snippet")


@query("sections", b.with_views("""
    SELECT notice_id, unnest([name, own]) AS name, line FROM (
      SELECT notice_id, lower(title) AS own, 'eligibility' AS name, 'Open to ' || CASE WHEN region = 'Africa' THEN 'African' ELSE 'European' END || ' citizens.' AS line FROM notices
      UNION ALL SELECT notice_id, lower(title), 'eligibility', 'Applicants must be at least ' || min_age || ' years old.' FROM notices
      UNION ALL SELECT notice_id, lower(title), 'important dates', 'Applications open | ' || """ + DAY("opening_date") + """ FROM notices
      UNION ALL SELECT notice_id, lower(title), 'important dates', 'Application deadline | ' || """ + DAY("deadline_date") + """ FROM notices
      UNION ALL SELECT notice_id, lower(title), 'important dates', 'Orientation | January 5, 2031' FROM notices
      UNION ALL SELECT notice_id, lower(title), 'funding', CASE flights WHEN 'covered' THEN 'Flights are covered.' WHEN 'not_covered' THEN 'Flights are not covered.'
                  WHEN 'reimbursed' THEN 'We reimburse flights.' ELSE 'Come as you are.' END || ' ' || CASE accommodation WHEN 'covered' THEN 'Accommodation is provided.'
                  WHEN 'partially_covered' THEN 'Housing is partially covered.' ELSE 'Bring a coat.' END || ' Mentorship by staff.' FROM notices
      UNION ALL SELECT notice_id, lower(title), 'funding', 'A stipend of ' || stipend || ' per month.' FROM notices
      UNION ALL SELECT notice_id, lower(title), 'how to apply', CASE WHEN fee THEN 'An application fee of USD 20 applies.' WHEN NOT fee THEN 'No application fee.' ELSE 'Send your papers.' END
                  || CASE WHEN cv THEN ' Submit a CV.' ELSE '' END FROM notices
      UNION ALL SELECT notice_id, lower(title), 'how to apply', 'Rolling applications.' FROM notices WHERE rolling)
    WHERE line IS NOT NULL
    UNION ALL SELECT notice_id, lower(title), 'Location: Hall ' || notice_id || ', ' || country FROM notices
    UNION ALL SELECT notice_id, lower(title), x FROM notices, (SELECT unnest(['Eligibility', 'Important Dates', 'Funding', 'How to Apply']) AS x)""", "notices"))
def sections(spark, sf):
    """Every line of every section; the H1 section of a page holds all that follows it, sub-headings and their lines too."""
    return pg.sections_table(_features(spark, sf, "nodes"), "notice_id").select("notice_id", "name", "line")


@query("section_text", b.with_views("""
    SELECT notice_id, 'Open to ' || CASE WHEN region = 'Africa' THEN 'African' ELSE 'European' END || ' citizens.'
           || coalesce(chr(10) || 'Applicants must be at least ' || min_age || ' years old.', '') AS eligibility,
           CASE WHEN fee THEN 'An application fee of USD 20 applies.' WHEN NOT fee THEN 'No application fee.' ELSE 'Send your papers.' END
           || CASE WHEN cv THEN ' Submit a CV.' ELSE '' END || CASE WHEN rolling THEN chr(10) || 'Rolling applications.' ELSE '' END AS application
    FROM notices""", "notices"))
def section_text(spark, sf):
    rows = _features(spark, sf, "nodes").select("notice_id", pg.section_list(F.col("nodes")).alias("s"))
    return rows.select(
        "notice_id", pg.section_text(F.col("s"), "eligibility").alias("eligibility"),
        pg.section_text(F.col("s"), "application").alias("application"),
    )


@query("jsonld", b.with_views("""
    SELECT notice_id, 0 AS record_no, 'thing,place' AS types, country AS name FROM notices
    UNION ALL SELECT notice_id, 1, 'event', title FROM notices""", "notices"))
def jsonld(spark, sf):
    rows = pg.jsonld_records(b.notice_pages(spark, sf).select("notice_id", pg.jsonld_scripts(F.col("raw_html")).alias("jsonld")), "notice_id")
    return rows.select(
        "notice_id", "record_no", F.array_join("types", ",").alias("types"), F.get_json_object("record", "$.name").alias("name")
    )


@query("page_shape", b.with_views("""
    SELECT notice_id, 'specific_opportunity' AS shape, 'title of one opportunity, with facts or a way to apply' AS signals,
           '' AS children
    FROM notices""", "notices"))
def page_shape(spark, sf):
    shaped = cl.with_page_shape(_features(spark, sf))
    return shaped.select(
        "notice_id", "shape", F.array_join("shape_signals", ",").alias("signals"),
        F.array_join(F.transform("child_urls", lambda u: u), ",").alias("children"),
    )


@query("page_shape_pages", """
    SELECT page_id, 'uncertain' AS shape FROM pages""")
def page_shape_pages(spark, sf):
    return cl.with_page_shape(pg.page_features(b.table(spark, sf, "pages"))).select("page_id", "shape")


@query("visited_class", b.with_views("""
    SELECT notice_id, 'specific_opportunity' AS visited_class FROM notices""", "notices"))
def visited_class(spark, sf):
    f = pg.page_elements(b.notice_pages(spark, sf), "notice_id")
    score = F.when(F.col("notice_id") % 2 == 0, 7).otherwise(1)
    return f.select("notice_id", cl.visited_class(F.col("nodes"), cl.visit_title(F.col("nodes"), F.col("page_title")), score).alias("visited_class"))


@query("link_score", b.with_views("""
    SELECT notice_id, s AS link_score, CASE WHEN region <> 'Africa' AND NOT cv THEN 'non_opportunity' WHEN s >= 6 THEN 'specific_opportunity' WHEN s >= 3 THEN 'uncertain' ELSE 'non_opportunity' END AS link_class
    FROM (SELECT *, CASE WHEN true THEN 3 ELSE 0 END + CASE WHEN cv THEN 2 ELSE 0 END + CASE WHEN field = 'Robotics' THEN 1 ELSE 0 END + 1
                 + CASE WHEN cv THEN 2 ELSE 0 END + CASE WHEN region = 'Africa' THEN 1 ELSE 0 END AS s FROM notices)""", "notices"))
def link_score(spark, sf):
    n = b.view(spark, sf, "notices")
    rows = n.select(
        "notice_id", F.col("title").alias("label"), F.when(F.col("cv"), "Apply to this programme").otherwise("").alias("context"), "canonical",
        F.when(F.col("region") == "Africa", "https://example.org/").otherwise("https://elsewhere.test/").alias("source_url"),
        F.array(F.lit("robotics")).alias("category_focus"),
    )
    return cl.classify_links(cl.score_links(rows)).select("notice_id", "link_score", "link_class")


@query("eligibility_facts", b.with_views("""
    SELECT notice_id, min_age, CASE WHEN region = 'Africa' THEN 'Africa' ELSE 'Europe' END AS regions, true AS complete,
           'Open to ' || CASE WHEN region = 'Africa' THEN 'African' ELSE 'European' END || ' citizen' AS region_snippet
    FROM notices""", "notices"))
def eligibility_facts(spark, sf):
    rows = _features(spark, sf, "nodes").select("notice_id", pg.section_list(F.col("nodes")).alias("s"))
    rows = rows.withColumn("e", pg.section_text(F.col("s"), "eligibility"))
    done = fx.eligibility_facts(rows, "e", "s")
    return done.select(
        "notice_id", F.col("eligibility.minimum_age").alias("min_age"), F.array_join("eligibility.regions_allowed", ",").alias("regions"),
        F.col("eligibility.requirements_complete").alias("complete"),
        F.get(F.filter("eligibility_snippets", lambda s: s.startswith("Open to")), 0).alias("region_snippet"),
    )


_FACTS = f"""
    SELECT notice_id, title, organization, word AS category, country, opening_date, deadline, rolling, min_age, stipend || ' per month' AS stipend, flights, fee,
           CASE WHEN fee THEN 'USD 20' END AS fee_amount, CASE WHEN cv THEN true END AS cv_required,
           regexp_extract(page_url, '^(https://[^/]*)', 1) || '/apply/' || notice_id AS application_url,
           CASE WHEN deadline < t THEN 'closed' WHEN deadline <= t + interval 7 day THEN 'closing_soon'
           WHEN opening_date > cast(t as date) THEN CASE WHEN year(opening_date) > year(t) THEN 'future_cycle' ELSE 'opening_soon' END
           ELSE 'open' END AS status
    FROM (SELECT * REPLACE (CASE word WHEN 'Hackathon' THEN 'Hackathon / Competition' ELSE word END AS word) FROM notices), (SELECT timestamp '{b.AS_OF}' AS t)"""


@query("identity_facts", b.with_views(_FACTS, "notices"))
def identity_facts(spark, sf):
    opps, _ = fx.extract(_features(spark, sf).withColumn("seq", F.col("notice_id")))
    return opps.select(
        F.col("seq").alias("notice_id"), "title", "organization", "category", "country", "opening_date", "deadline",
        F.col("rolling_application").alias("rolling"), F.col("eligibility.minimum_age").alias("min_age"), F.col("funding.stipend").alias("stipend"),
        F.col("funding.flights.status").alias("flights"), F.col("application.application_fee").alias("fee"),
        F.col("application.fee_amount").alias("fee_amount"), F.col("application.cv_required").alias("cv_required"), "application_url", "status",
    )


@query("evidence", b.with_views("""
    SELECT notice_id, field, value, evidence_text FROM (
      SELECT notice_id, 'deadline' AS field, strftime(deadline, '%Y-%m-%dT%H:%M:%S') AS value, 'Application deadline | ' || """ + DAY("deadline_date") + """ AS evidence_text FROM notices
      UNION ALL SELECT notice_id, 'opening_date', cast(opening_date as varchar), 'Applications open | ' || """ + DAY("opening_date") + """ FROM notices
      UNION ALL SELECT notice_id, 'funding.stipend', stipend || ' per month', 'A stipend of ' || stipend || ' per month' FROM notices
      UNION ALL SELECT notice_id, 'funding.flights', CASE WHEN flights <> 'unknown' THEN flights END, CASE flights WHEN 'covered' THEN 'Flights are covered.'
                WHEN 'not_covered' THEN 'Flights are not covered.' ELSE 'We reimburse flights.' END FROM notices
      UNION ALL SELECT notice_id, 'application.application_fee', CASE WHEN fee THEN 'True' WHEN NOT fee THEN 'False' END, CASE WHEN fee THEN 'An application fee of USD 20 applies.' ELSE 'No application fee.' END FROM notices)
    WHERE value IS NOT NULL""", "notices"))
def evidence(spark, sf):
    opps, _ = fx.extract(_features(spark, sf).withColumn("seq", F.col("notice_id")))
    rows = opps.select(F.col("seq").alias("notice_id"), F.explode("evidence").alias("e"))
    wanted = ("deadline", "opening_date", "funding.stipend", "funding.flights", "application.application_fee")
    return rows.select("notice_id", "e.field", "e.value", "e.evidence_text").where(F.col("field").isin(*wanted))


@query("diagnostics", b.with_views("""
    SELECT notice_id, CASE WHEN deadline IS NOT NULL OR rolling THEN 'deadline,' ELSE '' END || 'eligibility,funding,'
           || CASE WHEN fee IS NOT NULL OR cv THEN 'application_requirements,' ELSE '' END || 'application_url' AS found, '' AS warnings
    FROM notices""", "notices"))
def diagnostics(spark, sf):
    opps, _ = fx.extract(_features(spark, sf).withColumn("seq", F.col("notice_id")))
    d = "extraction_diagnostics."
    return opps.select(
        F.col("seq").alias("notice_id"), F.array_join(d + "material_fields_found", ",").alias("found"), F.array_join(d + "warnings", ",").alias("warnings")
    )


@query("evidence_check", b.with_views("""
    SELECT notice_id, fact FROM (
      SELECT notice_id, CASE WHEN deadline IS NOT NULL AND notice_id % 2 = 1 THEN 'deadline' END AS fact FROM notices
      UNION ALL SELECT notice_id, 'hard eligibility' FROM notices
      UNION ALL SELECT notice_id, CASE WHEN flights <> 'unknown' AND notice_id % 3 <> 0 THEN 'flights' END FROM notices
      UNION ALL SELECT notice_id, CASE WHEN accommodation <> 'unknown' THEN 'accommodation' END FROM notices
      UNION ALL SELECT notice_id, CASE WHEN stipend IS NOT NULL THEN 'stipend' END FROM notices
      UNION ALL SELECT notice_id, CASE WHEN fee IS NOT NULL THEN 'application fee' END FROM notices
      UNION ALL SELECT notice_id, 'application URL' FROM notices) WHERE fact IS NOT NULL""", "notices"))
def evidence_check(spark, sf):
    opps = b.notice_records(spark, sf)
    shown = F.struct(
        F.lit("deadline").alias("field"), F.lit("x").alias("value"), F.col("source_url").alias("source_url"), F.lit("high").alias("confidence"),
        F.lit("x").alias("evidence_text"),
    )
    changed = F.struct(
        F.lit("funding.flights.status").alias("field"), F.lit("").alias("previous_value"), F.lit("").alias("override_value"), F.lit("f").alias("source_file"),
    )
    opps = opps.withColumn("evidence", F.when(F.col("seq") % 2 == 0, F.array(shown)).otherwise(F.col("evidence")))
    opps = opps.withColumn("manual_overrides", F.when(F.col("seq") % 3 == 0, F.array(changed)).otherwise(F.col("manual_overrides")))
    return fx.evidence_violations(opps).select(F.col("opportunity_key").cast("long").alias("notice_id"), "fact")


@query("grounding", """
    SELECT doc_id, kind, 'snippet' AS reason FROM (
      SELECT doc_id, 'absent' AS kind FROM documents UNION ALL SELECT doc_id, 'empty' FROM documents)
    UNION ALL SELECT doc_id, 'elsewhere', 'url' FROM documents""")
def grounding(spark, sf):
    docs = b.table(spark, sf, "documents")
    home = F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string"))
    pages = docs.select(
        F.col("doc_id").alias("page_key"), F.col("text").alias("page_text"), home.alias("requested_url"), home.alias("final_url")
    )
    middle = F.substring(F.col("text"), F.floor(F.length("text") / 2).cast("int"), F.lit(60))
    rows = docs.select(
        F.col("doc_id").alias("page_key"), F.explode(F.array(
            F.struct(F.lit("present").alias("kind"), F.upper(middle).alias("evidence_text"), home.alias("source_url")),
            F.struct(F.lit("absent").alias("kind"), F.lit("zq qz zq").alias("evidence_text"), home.alias("source_url")),
            F.struct(F.lit("empty").alias("kind"), F.lit(" ").alias("evidence_text"), home.alias("source_url")),
            F.struct(F.lit("elsewhere").alias("kind"), F.substring("text", 1, 20).alias("evidence_text"), F.lit("https://other.example/").alias("source_url")),
        )).alias("e"),
    ).select("page_key", "e.*")
    return fx.ungrounded(rows, pages).select(F.col("page_key").alias("doc_id"), "kind", "reason")


@query("fingerprint", b.with_views("""
    SELECT notice_id, min(notice_id) OVER (PARTITION BY title, organization, country, region, opening_date, deadline, rolling, min_age, stipend, flights, accommodation, fee, cv, mode) AS same_as
    FROM notices""", "notices"))
def fingerprint(spark, sf):
    n = b.view(spark, sf, "notices")
    fields = ("title", "organization", "country", "region", "opening_date", "deadline", "rolling", "min_age", "stipend", "flights", "accommodation", "fee", "cv", "mode")
    keyed = n.select("notice_id", hs.fingerprint(F.struct(*fields)).alias("fp"))
    first = keyed.groupBy("fp").agg(F.min("notice_id").alias("same_as"))
    return keyed.join(first, "fp").select("notice_id", "same_as")




@query("dedup", b.with_views(f"""
    SELECT min(notice_id) AS survivor, count(*) - 1 AS duplicates
    FROM (SELECT *, coalesce(year(deadline), year(opening_date), cast(regexp_extract(title, '20[0-9][0-9]') as bigint)) AS cycle FROM notices)
    GROUP BY organization, title, cycle, CASE WHEN organization IS NULL THEN notice_id END""", "notices"))
def dedup(spark, sf):
    survivors, duplicates = hs.dedup(b.notice_records(spark, sf))
    counts = duplicates.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("duplicates"))
    return survivors.select("dedup_key", F.col("seq").alias("survivor")).join(counts, "dedup_key", "left").select(
        "survivor", F.coalesce("duplicates", F.lit(0)).alias("duplicates")
    )


@query("needs_enrichment", b.with_views("""
    SELECT notice_id, region = 'Africa' AS wanted FROM notices""", "notices"))
def needs_enrichment(spark, sf):
    unknown = F.when(F.col("region_name") == "Africa", F.array(F.lit("funding"), F.lit("application_url"))).otherwise(F.array(F.lit("application_url")))
    opps = b.notice_records(spark, sf).join(
        b.view(spark, sf, "notices").select(F.col("notice_id").cast("string").alias("opportunity_key"), F.col("region").alias("region_name")), "opportunity_key"
    )
    opps = opps.withColumn("extraction_diagnostics", F.col("extraction_diagnostics").withField("material_fields_unknown", unknown))
    return opps.select(F.col("seq").alias("notice_id"), en.needs_enrichment(opps).alias("wanted"))


def _partner_records(spark, sf):
    """Each notice's application page is the next notice's record."""
    opps = b.notice_records(spark, sf)
    unknown = F.array(F.lit("deadline"), F.lit("funding"))
    opps = opps.withColumn("extraction_diagnostics", F.col("extraction_diagnostics").withField("material_fields_unknown", unknown))
    here = F.concat(F.lit("https://apply.example.org/"), F.col("seq").cast("string"))
    there = F.concat(F.lit("https://apply.example.org/"), (F.col("seq") + 1).cast("string"))
    return opps.withColumn("application_url", there), opps.withColumn("official_url", here)


@query("enrich_merge", b.with_views("""
    SELECT a.notice_id, CASE WHEN m THEN coalesce(z.deadline, a.deadline) ELSE a.deadline END AS deadline,
           CASE WHEN m THEN coalesce(z.min_age, a.min_age) ELSE a.min_age END AS min_age,
           CASE WHEN m AND z.flights <> 'unknown' THEN z.flights ELSE a.flights END AS flights,
           CASE WHEN m THEN coalesce(z.stipend, a.stipend) ELSE a.stipend END AS stipend,
           CASE WHEN m AND a.region <> z.region THEN a.region || ',' || z.region ELSE a.region END AS regions,
           CASE WHEN m THEN (CASE WHEN a.deadline <> z.deadline THEN 1 ELSE 0 END) + (CASE WHEN a.opening_date <> z.opening_date THEN 1 ELSE 0 END)
             + (CASE WHEN a.min_age <> z.min_age THEN 1 ELSE 0 END) + (CASE WHEN a.flights <> 'unknown' AND z.flights <> 'unknown' AND a.flights <> z.flights THEN 1 ELSE 0 END)
             + (CASE WHEN a.accommodation <> 'unknown' AND z.accommodation <> 'unknown' AND a.accommodation <> z.accommodation THEN 1 ELSE 0 END)
             + (CASE WHEN a.stipend <> z.stipend THEN 1 ELSE 0 END) + (CASE WHEN a.fee <> z.fee THEN 1 ELSE 0 END) + (CASE WHEN a.cv <> z.cv THEN 1 ELSE 0 END) ELSE 0 END AS conflicts
    FROM notices a LEFT JOIN notices z ON z.notice_id = a.notice_id + 1,
         LATERAL (SELECT coalesce(len(list_intersect(list_filter(string_split(lower(a.title), ' '), lambda w: w NOT IN ('2026', '2027')),
           list_filter(string_split(lower(z.title), ' '), lambda w: w NOT IN ('2026', '2027')))) > 0 OR a.organization = z.organization, false) AS m)""", "notices"))
def enrich_merge(spark, sf):
    primary, others = _partner_records(spark, sf)
    merged = en.enrich_merge(primary, others)
    return merged.select(
        F.col("seq").alias("notice_id"), "deadline", F.col("eligibility.minimum_age").alias("min_age"), F.col("funding.flights.status").alias("flights"),
        F.col("funding.stipend").alias("stipend"), F.array_join("eligibility.regions_allowed", ",").alias("regions"),
        F.size("extraction_diagnostics.conflicts").alias("conflicts"),
    )


@query("override", b.with_views("""
    SELECT notice_id, CASE WHEN notice_id % 4 = 1 THEN 'New name' ELSE title END AS title,
           CASE WHEN notice_id % 4 = 1 THEN 21 ELSE min_age END AS min_age,
           CASE WHEN notice_id % 4 = 1 THEN 'covered' ELSE flights END AS flights,
           CASE WHEN notice_id % 4 = 1 THEN 'Kenya,Ghana' ELSE '' END AS nationalities,
           CASE WHEN notice_id % 4 = 1 THEN 'eligibility.minimum_age,eligibility.nationalities_allowed,funding.flights.status,title' ELSE '' END AS changed
    FROM notices""", "notices"))
def override(spark, sf):
    opps = b.notice_records(spark, sf)
    entries = (("title", '"New name"'), ("eligibility.minimum_age", "21"), ("funding.flights.status", '"covered"'),
               ("eligibility.nationalities_allowed", '["Kenya","Ghana"]'), ("no.such.field", "1"))
    leaves = opps.where(F.col("seq") % 4 == 1).select(
        F.col("source_url").alias("url"),
        F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("value")) for p, v in entries])).alias("x"),
    ).select("url", "x.path", "x.value")
    done = en.apply_overrides(opps, leaves, "overrides.json")
    return done.select(
        F.col("seq").alias("notice_id"), "title", F.col("eligibility.minimum_age").alias("min_age"), F.col("funding.flights.status").alias("flights"),
        F.array_join("eligibility.nationalities_allowed", ",").alias("nationalities"),
        F.array_join(F.array_sort(F.transform("manual_overrides", lambda o: o["field"])), ",").alias("changed"),
    )
