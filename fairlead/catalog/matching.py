"""Profiles against notices: eligibility, concepts, scores, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairlead import vocab
from fairlead.catalog.base import query
from fairlead.operators import assess as av, digest as dg, geo, matching as mt, notify as nt, reports as rp
from fairlead.sources import bindings as b

VIEWS = ("notices", "seekers", "pairs")


def _sql_case(column: str, table: dict, otherwise: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


def _in_region(place: str) -> str:
    arms = []
    for region in b.REGIONS:
        members = [c for c in b.COUNTRIES if c.lower() in vocab.REGION_COUNTRIES[region.lower()]]
        arms.append(f"WHEN '{region}' THEN {place} IN ({', '.join(map(repr, members))})")
    return f"CASE region {' '.join(arms)} END"


CONCEPT = _sql_case("field", {
    "Cloud Security": "cloud security", "Open Source": "open source", "Marine Biology": "marine biology",
    "Machine Learning": "artificial intelligence", "Cyber Security": "cybersecurity", "AppSec": "application security",
})
STATUS = f"""CASE WHEN deadline < timestamp '{b.AS_OF}' THEN 'closed' WHEN deadline <= timestamp '{b.AS_OF}' + interval 7 day THEN 'closing_soon'
    WHEN opening_date > date '{b.AS_OF[:10]}' THEN CASE WHEN year(opening_date) > 2019 THEN 'future_cycle' ELSE 'opening_soon' END
    WHEN deadline IS NOT NULL AND opening_date IS NOT NULL THEN 'open' WHEN rolling THEN 'open' ELSE 'unknown' END"""
LEVELS = f"""
  levels AS (
    SELECT *, CASE WHEN blockers > 0 THEN 'not_eligible' WHEN cv THEN 'eligible' ELSE 'likely_eligible' END AS eligibility_status,
           CASE WHEN weight = 4 THEN 'strong_direct_fit' WHEN weight >= 2 THEN 'moderate_adjacent_fit' WHEN field = 'Robotics' THEN 'credible_discovery'
                ELSE 'little_meaningful_fit' END AS relevance_level,
           CASE least(5, signals) WHEN 5 THEN 'exceptional_multi_dimensional' WHEN 4 THEN 'very_high' WHEN 3 THEN 'strong' ELSE 'moderate' END AS value_level,
           CASE WHEN mode = 'remote' THEN 'very_feasible' WHEN mode = 'in_person' AND flights = 'not_covered' THEN 'significant_practical_barriers'
                ELSE 'feasible_with_unknowns' END AS feasibility_level,
           CASE status WHEN 'open' THEN 'open_healthy_window' WHEN 'closing_soon' THEN 'closing_soon' WHEN 'closed' THEN 'closed_expired' WHEN 'unknown' THEN 'date_status_unclear'
                ELSE 'future_preparation_window' END AS timing_level,
           CASE WHEN fee THEN 'high' WHEN cv THEN 'low' ELSE 'very_low' END AS friction_level
    FROM (SELECT *, 2 + (CASE WHEN stipend IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN flights IN ('covered', 'reimbursed') THEN 1 ELSE 0 END)
                 + (CASE WHEN accommodation = 'covered' THEN 1 ELSE 0 END) + (CASE WHEN weight = 4 THEN 1 ELSE 0 END)
                 + (CASE WHEN country NOT IN (nationality, residence) THEN 1 ELSE 0 END) AS signals
          FROM (SELECT p.profile_id, n.*, s.nationality, s.residence, s.age, {STATUS} AS status,
                       CASE WHEN {CONCEPT} = s.skill THEN 4 WHEN {CONCEPT} = s.second_skill THEN 3 ELSE 0 END AS weight,
                       (CASE WHEN {_in_region('s.nationality')} THEN 0 ELSE 1 END) + (CASE WHEN s.age < n.min_age THEN 1 ELSE 0 END) AS blockers
                FROM pairs p JOIN notices n USING (notice_id) JOIN seekers s USING (profile_id)))),
  scored AS (
    SELECT *, {_sql_case('eligibility_status', vocab.ELIGIBILITY_SCORES)} + {_sql_case('relevance_level', vocab.RELEVANCE_SCORES)}
           + {_sql_case('value_level', vocab.VALUE_SCORES)} + {_sql_case('feasibility_level', vocab.FEASIBILITY_SCORES)}
           + {_sql_case('timing_level', vocab.TIMING_SCORES)} + {_sql_case('friction_level', vocab.FRICTION_SCORES)} + 3 AS total_score FROM levels),
  banded AS (
    SELECT *, CASE WHEN blockers > 0 THEN 'not_actionable' WHEN relevance_level = 'credible_discovery' AND total_score >= 40 THEN 'discovery'
           WHEN relevance_level = 'credible_discovery' THEN NULL WHEN total_score >= 85 THEN 'exceptional' WHEN total_score >= 70 THEN 'strong_match'
           WHEN total_score >= 55 THEN 'worth_checking' WHEN total_score >= 40 THEN 'low_priority' ELSE 'not_actionable' END AS priority_band FROM scored),
  assessed AS (
    SELECT *, CASE WHEN eligibility_status = 'not_eligible' THEN 'ignore' WHEN status = 'future_cycle' THEN 'track'
           WHEN status = 'opening_soon' AND priority_band IN ('exceptional', 'strong_match', 'worth_checking') THEN 'prepare'
           WHEN priority_band = 'exceptional' THEN 'apply_now' WHEN priority_band IN ('strong_match', 'worth_checking') THEN 'check_now'
           WHEN priority_band = 'discovery' THEN 'save' ELSE 'ignore' END AS action,
           'identity' AS one FROM banded WHERE priority_band IS NOT NULL),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY -total_score, coalesce(trim(regexp_replace(lower(organization), '[^a-z0-9]+', ' ', 'g')), ''),
           trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), coalesce(strftime(deadline, '%Y-%m-%dT%H:%M:%S'), '9999-12-31'),
           lower(page_url), cast(notice_id as varchar)) AS rank FROM assessed),
  placed AS (SELECT *, row_number() OVER (PARTITION BY profile_id, priority_band ORDER BY rank) AS n FROM ranked),
  chosen AS (
    SELECT * FROM placed WHERE (priority_band = 'exceptional' AND n <= 3) OR (priority_band = 'strong_match' AND n <= 4) OR (priority_band = 'discovery' AND n <= 2)),
  selected AS (
    SELECT * FROM chosen UNION ALL
    SELECT p.* FROM placed p LEFT JOIN (SELECT profile_id, count(*) AS c FROM chosen GROUP BY 1) t USING (profile_id)
    WHERE priority_band = 'worth_checking' AND n <= 5 - coalesce(c, 0))"""


def sql(select: str) -> str:
    return b.with_views("", *VIEWS).rstrip() + "," + LEVELS + select


def _ids(df, *columns):
    return df.select(F.col("profile_id").cast("long").alias("profile_id"), F.col("opportunity_key").cast("long").alias("notice_id"), *columns)


def as_of():
    return F.to_date(F.lit(b.AS_OF[:10]))


def assessments(spark, sf):
    """Assessed pairs with the facts ranking and notification need."""
    opps = b.notice_records(spark, sf)
    good, failed = av.assess(b.notice_pairs(spark, sf), opps, b.seeker_profiles(spark, sf), as_of())
    facts = opps.select(
        "opportunity_key", "seq", "title", "organization", "deadline", "rolling_application", "status", "official_url", "application_url", "source_url"
    )
    return good.join(facts, "opportunity_key"), failed


@query("geo_match", b.with_views(f"""
    SELECT profile_id, notice_id FROM pairs JOIN notices USING (notice_id) JOIN seekers USING (profile_id) WHERE {_in_region('nationality')}""", *VIEWS))
def geo_match(spark, sf):
    n = b.view(spark, sf, "notices").select("notice_id", F.array("region").alias("regions"))
    return geo.geo_match(
        b.view(spark, sf, "seekers"), n, b.view(spark, sf, "pairs"), "nationality", "regions", "profile_id", "notice_id"
    ).select("profile_id", "notice_id")


@query("eligibility", sql(" SELECT profile_id, notice_id, eligibility_status, blockers, CASE WHEN eligibility_status = 'likely_eligible' THEN 'medium' ELSE 'high' END AS confidence, "
                          "1 + (CASE WHEN min_age IS NULL THEN 0 ELSE 1 END) AS checks FROM levels"))
def eligibility(spark, sf):
    rules = mt.opportunity_rules(b.notice_records(spark, sf))
    facts = mt.profile_facts(b.seeker_profiles(spark, sf), as_of())
    done = mt.eligibility(b.notice_pairs(spark, sf), rules, facts)
    return _ids(
        done, "eligibility_status", F.size("hard_blockers").alias("blockers"), F.col("eligibility_confidence").alias("confidence"),
        F.col("checks_applied").alias("checks"),
    )


@query("profile_signals", b.with_views("""
    SELECT profile_id, signal_no, concept, weight FROM (
      SELECT profile_id, 0 AS signal_no, skill AS concept, 4 AS weight FROM seekers UNION ALL SELECT profile_id, 1, second_skill, 3 FROM seekers
      UNION ALL SELECT profile_id, 2, skill, 2 FROM seekers UNION ALL SELECT profile_id, 3, 'web3', 2 FROM seekers)""", "seekers"))
def profile_signals(spark, sf):
    return mt.profile_signals(b.seeker_profiles(spark, sf)).select(F.col("profile_id").cast("long").alias("profile_id"), "signal_no", "concept", "weight")


def _matches(spark, sf):
    texts = av.judged_opportunities(b.notice_records(spark, sf)).select("opportunity_key", "text")
    return mt.concept_match(b.notice_pairs(spark, sf), mt.profile_signals(b.seeker_profiles(spark, sf)), texts)


@query("concept_match", sql(f" SELECT profile_id, notice_id, {CONCEPT} AS concept, weight FROM levels WHERE weight > 0"))
def concept_match(spark, sf):
    return _ids(_matches(spark, sf), "concept", "weight")


@query("relevance", sql(" SELECT profile_id, notice_id, weight AS strongest, 1 AS strong_count FROM levels WHERE weight > 0"))
def relevance(spark, sf):
    return _ids(mt.relevance(_matches(spark, sf)), "strongest", "strong_count")


@query("value_level", sql(" SELECT profile_id, notice_id, relevance_level, value_level, signals FROM levels"))
def value_level(spark, sf):
    done = av.judge(b.notice_pairs(spark, sf), b.notice_records(spark, sf), b.seeker_profiles(spark, sf))
    return _ids(done, "relevance_level", "value_level", F.size("top_positive_signals").alias("signals"))


@query("friction", b.with_views(f"""
    SELECT notice_id, CASE WHEN fee THEN 'high' WHEN cv THEN 'low' ELSE 'very_low' END AS friction,
           CASE WHEN mode = 'remote' THEN 'very_feasible' WHEN mode = 'in_person' AND flights = 'not_covered' THEN 'significant_practical_barriers' ELSE 'feasible_with_unknowns' END AS feasibility,
           {STATUS} AS status, (CASE WHEN deadline IS NULL AND NOT rolling THEN 1 ELSE 0 END) + (CASE WHEN cv THEN 0 ELSE 1 END)
             + (CASE WHEN mode = 'in_person' THEN 1 + (CASE WHEN flights = 'unknown' THEN 1 ELSE 0 END) + (CASE WHEN accommodation = 'unknown' THEN 1 ELSE 0 END) ELSE 0 END) AS concerns
    FROM notices""", "notices"))
def friction(spark, sf):
    done = av.judged_opportunities(b.notice_records(spark, sf))
    return done.select(
        F.col("opportunity_key").cast("long").alias("notice_id"), F.col("friction_level").alias("friction"), F.col("feasibility_level").alias("feasibility"),
        F.col("opportunity_status").alias("status"), F.size("judged_concerns").alias("concerns"),
    )


@query("total_score", sql(" SELECT profile_id, notice_id, total_score FROM assessed"))
def total_score(spark, sf):
    return _ids(assessments(spark, sf)[0], "total_score")


@query("priority_band", sql(" SELECT profile_id, notice_id, priority_band FROM banded"))
def priority_band(spark, sf):
    good, failed = assessments(spark, sf)
    return _ids(good, "priority_band").unionByName(_ids(failed, F.lit(None).cast("string").alias("priority_band")))


@query("action", sql(" SELECT profile_id, notice_id, action FROM assessed"))
def action(spark, sf):
    return _ids(assessments(spark, sf)[0], F.col("recommended_action").alias("action"))


@query("digest_rank", sql(" SELECT profile_id, notice_id, rank FROM ranked"))
def digest_rank(spark, sf):
    good, _ = assessments(spark, sf)
    ranked_by = ("total_score", "organization", "title", "deadline", "official_url", "application_url", "source_url")
    return _ids(dg.digest_rank(good.select("profile_id", "opportunity_key", *ranked_by), keep=("opportunity_key",)), "rank")


@query("digest_select", sql(" SELECT profile_id, notice_id, CASE priority_band WHEN 'exceptional' THEN 1 WHEN 'strong_match' THEN 2 WHEN 'discovery' THEN 3 ELSE 4 END AS section, n AS place FROM selected"))
def digest_select(spark, sf):
    return _ids(dg.digest_select(assessments(spark, sf)[0]), "section", F.col("band_rank").alias("place"))


@query("not_selected", sql(" SELECT profile_id, notice_id FROM assessed ANTI JOIN selected USING (profile_id, notice_id)"))
def not_selected(spark, sf):
    good, _ = assessments(spark, sf)
    return _ids(dg.not_selected(good, dg.digest_select(good)))


# --- notifications over the assessed pairs --------------------------------------------

_CHANGE = "CASE notice_id % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'known_unchanged' END"
_PLANS = f""",
  items AS (
    SELECT *, {_CHANGE} AS change_class, status <> 'closed' AND priority_band <> 'not_actionable' AS actionable,
           notice_id % 3 < 2 AS moved, (profile_id + notice_id) % 10 = 0 AS sent_now, (profile_id + notice_id) % 10 = 1 AS sent_daily FROM assessed),
  now AS (
    SELECT * FROM items WHERE actionable AND moved AND (priority_band = 'exceptional' OR (priority_band = 'strong_match'
           AND (status = 'closing_soon' OR (status = 'open' AND (notice_id % 3 = 0 OR notice_id % 2 = 0))))) AND NOT sent_now),
  daily AS (
    SELECT * FROM items ANTI JOIN now USING (profile_id, notice_id) WHERE actionable AND priority_band <> 'low_priority'
           AND (status = 'closing_soon' OR priority_band IN ('exceptional', 'strong_match') OR (moved AND priority_band IN ('worth_checking', 'discovery')))
           AND NOT sent_now AND NOT sent_daily),
  planned AS (SELECT *, 'immediate_alert' AS kind, notice_id AS part FROM now UNION ALL SELECT *, 'daily_digest', -1 FROM daily)"""


def notification_items(spark, sf):
    good, _ = assessments(spark, sf)
    n = F.col("opportunity_key").cast("long")
    return good.withColumns({
        "item_id": F.concat_ws("-", "profile_id", "opportunity_key"), "fingerprint": F.sha2("opportunity_key", 256),
        "change_class": F.when(n % 3 == 0, "new").when(n % 3 == 1, "changed").otherwise("known_unchanged"),
        "changed_fields": F.when(n % 2 == 0, F.array(F.lit("status"))).otherwise(F.array(F.lit("deadline"))),
    })


def _sent(spark, sf):
    p = b.notice_pairs(spark, sf)
    turn = (F.col("profile_id").cast("long") + F.col("opportunity_key").cast("long")) % 10
    return p.select(
        F.concat_ws("-", "profile_id", "opportunity_key").alias("item_id"), F.sha2("opportunity_key", 256).alias("fingerprint"),
        F.when(turn == 1, "daily_digest").otherwise("immediate_alert").alias("notification_type"),
        F.when(turn <= 1, "delivered").otherwise("failed").alias("delivery_status"),
    )


def planned(spark, sf):
    return nt.notify_plan(notification_items(spark, sf), _sent(spark, sf))


@query("notify_plan", sql(_PLANS + " SELECT profile_id, notice_id, kind FROM planned"))
def notify_plan(spark, sf):
    return _ids(planned(spark, sf), F.col("notification_type").alias("kind"))


@query("outbox", sql(_PLANS + """ SELECT kind, items, new, changed, closing_soon, severity, count(*) AS plans FROM (
    SELECT kind, profile_id, part, count(*) AS items, count(*) FILTER (change_class = 'new') AS new, count(*) FILTER (change_class = 'changed') AS changed,
           count(*) FILTER (status = 'closing_soon') AS closing_soon,
           CASE WHEN kind = 'daily_digest' THEN 'normal' WHEN count(*) FILTER (status = 'closing_soon') > 0 THEN 'urgent' ELSE 'high' END AS severity
    FROM planned GROUP BY 1, 2, 3) GROUP BY ALL"""))
def outbox(spark, sf):
    header, _ = nt.outbox(planned(spark, sf))
    return header.select(F.col("notification_type").alias("kind"), "items", "new", "changed", "closing_soon", "severity").groupBy(
        "kind", "items", "new", "changed", "closing_soon", "severity"
    ).agg(F.count(F.lit(1)).alias("plans"))


@query("outbox_items", sql(_PLANS + """ SELECT profile_id, notice_id, kind, row_number() OVER (PARTITION BY kind, profile_id, part
    ORDER BY total_score DESC, lower(title), notice_id) AS position, total_score || '/100' AS score_line FROM planned"""))
def outbox_items(spark, sf):
    _, items = nt.outbox(planned(spark, sf), keep=("profile_id", "opportunity_key", "notification_type"))
    # the plan rows of the items that were ranked, not planned a second time
    plans = items.select("plan_id", "item_id", "profile_id", "opportunity_key", F.col("notification_type").alias("kind"))
    rows = items.select("plan_id", "item_id", "position", "lines").join(plans, ["plan_id", "item_id"])
    return _ids(rows, "kind", "position", F.regexp_extract("lines", r"\n([0-9]+/100)", 1).alias("score_line"))


@query("notify_fp", sql(_PLANS + " SELECT kind, count(DISTINCT (profile_id, part)) AS plans, count(DISTINCT (profile_id, part)) AS fingerprints FROM planned GROUP BY kind"))
def notify_fp(spark, sf):
    marks = nt.notify_fp(planned(spark, sf))
    return marks.groupBy(F.col("notification_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("plans"), F.countDistinct("notification_fingerprint").alias("fingerprints")
    )


@query("heartbeat", sql(_PLANS + " SELECT profile_id FROM seekers ANTI JOIN planned USING (profile_id)"))
def heartbeat(spark, sf):
    runs = b.seeker_profiles(spark, sf).select("profile_id")
    beats = nt.heartbeat(runs, planned(spark, sf).select("profile_id").distinct(), "profile_id")
    return beats.select(F.col("profile_id").cast("long").alias("profile_id"))


@query("daily_summary", sql(f""" SELECT profile_id, count(*) AS opportunities_evaluated, count(*) FILTER (notice_id % 3 = 0) AS new_opportunities,
    count(*) FILTER (notice_id % 3 = 0 AND status <> 'closed' AND priority_band IN ('discovery', 'worth_checking', 'strong_match', 'exceptional')) AS new_worthwhile,
    count(*) FILTER (notice_id % 3 = 1) AS changed_opportunities, count(*) FILTER (status = 'closing_soon') AS closing_soon FROM assessed GROUP BY 1"""))
def daily_summary(spark, sf):
    return rp.daily_summary(notification_items(spark, sf), "profile_id").withColumn("profile_id", F.col("profile_id").cast("long"))


@query("change_sections", sql(f""" SELECT profile_id, section, count(*) AS records, cast(sum(notice_id) as bigint) AS ids FROM (
    SELECT profile_id, notice_id, 'new' AS section FROM assessed WHERE notice_id % 3 = 0 UNION ALL SELECT profile_id, notice_id, 'changed' FROM assessed WHERE notice_id % 3 = 1
    UNION ALL SELECT profile_id, notice_id, 'closing_soon' FROM assessed WHERE notice_id % 3 < 2 AND status = 'closing_soon'
    UNION ALL SELECT profile_id, notice_id, 'strong' FROM assessed WHERE notice_id % 3 < 2 AND priority_band IN ('exceptional', 'strong_match')) GROUP BY 1, 2"""))
def change_sections(spark, sf):
    rows = _ids(dg.change_sections(notification_items(spark, sf), only_changed=True), "section")
    return rows.groupBy("profile_id", "section").agg(F.count(F.lit(1)).alias("records"), F.sum("notice_id").alias("ids"))
