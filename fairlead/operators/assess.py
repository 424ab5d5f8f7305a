"""Judgements, scores, bands and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead import vocab
from fairlead.functions import text as tx
from fairlead.operators import contracts as ct, matching as mt

_TEXTS = "array<string>"
_APPLICATION_BURDENS = (
    "cv_required", "cover_letter_required", "transcript_required", "portfolio_required", "github_required",
    "video_required", "technical_assessment", "coding_challenge", "proposal_required", "pitch_deck_required",
    "nomination_required",
)


def score_of(level: Column, table: dict) -> Column:
    return F.try_element_at(tx.literal(table), level)


# --- per opportunity --------------------------------------------------------------

def opportunity_text() -> Column:
    e = F.col("eligibility")
    listed = lambda values: F.array_join(values, "\n")
    return F.concat_ws(
        "\n", "title", F.coalesce("organization", F.lit("")), "category", listed(F.col("subcategories")),
        F.coalesce("summary", F.lit("")), F.coalesce(e["raw_text"], F.lit("")), listed(e["required_skills"]),
        listed(e["preferred_skills"]),
    )


def frontier_term(norm_text: Column) -> Column:
    """Alphabetically first frontier term contained in the normalised text."""
    return F.get(F.filter(tx.literal(vocab.FRONTIER_TERMS), lambda t: F.contains(norm_text, t)), 0)


def friction(application: Column) -> Column:
    """Level from the number of application materials; a fee escalates it."""
    count = burden_count(application)
    return (
        F.when(application["application_fee"] & (count < 4), "high")
        .when(application["application_fee"], "very_high")
        .when(count == 0, "very_low").when(count <= 2, "low").when(count <= 5, "medium").otherwise("high")
    )


def burden_count(application: Column) -> Column:
    flags = sum((F.coalesce(application[n], F.lit(False)).cast("int") for n in _APPLICATION_BURDENS), F.lit(0))
    return flags + F.coalesce(F.size(application["essays"]), F.lit(0))


def feasibility(mode: Column, funding: Column) -> Column:
    paid = lambda name: funding[name]["status"].isin("covered", "reimbursed")
    unpaid = lambda name: funding[name]["status"] == "not_covered"
    return (
        F.when(mode == "remote", "very_feasible")
        .when((mode == "in_person") & paid("flights") & paid("accommodation") & paid("visa_support"), "mostly_feasible")
        .when((mode == "in_person") & (unpaid("flights") | unpaid("accommodation")), "significant_practical_barriers")
        .otherwise("feasible_with_unknowns")
    )


def timing(status: Column) -> Column:
    return (
        F.when(status == "open", "open_healthy_window").when(status == "closing_soon", "closing_soon")
        .when(status == "closed", "closed_expired")
        .when(status.isin("opening_soon", "future_cycle", "expected"), "future_preparation_window")
        .otherwise("date_status_unclear")
    )


def concerns(mode: Column, funding: Column) -> Column:
    unknown = lambda name: (mode == "in_person") & (funding[name]["status"] == "unknown")
    return tx.ordered_flags(
        (F.col("deadline").isNull() & ~F.coalesce(F.col("rolling_application"), F.lit(False)), "deadline unknown"),
        (~F.coalesce(F.col("eligibility.requirements_complete"), F.lit(False)), "requirements may be incomplete"),
        (unknown("flights"), "travel in person: flights unknown"),
        (unknown("accommodation"), "travel in person: accommodation unknown"),
        (unknown("visa_support"), "travel in person: visa support unknown"),
        (F.coalesce(F.col("semantic_input_truncated"), F.lit(False)), "text was cut before analysis"),
    )


def confidence(level: Column, truncated: Column) -> Column:
    cut = F.coalesce(truncated, F.lit(False))
    return F.when((level == "high") & ~cut, "high").when((level == "low") | cut, "low").otherwise("medium")


def _material_signals(funding: Column) -> Column:
    """Value signals that do not depend on the profile, before the alignment signal."""
    given = lambda name: F.coalesce(funding[name] != "", F.lit(False))
    covered = lambda name: funding[name]["status"].isin("covered", "reimbursed")
    labels = F.transform(F.coalesce(funding["other_benefits"], F.array().cast(_TEXTS)), tx.norm_alnum)
    return tx.ordered_flags(
        (F.coalesce(funding["paid"], F.lit(False)) | given("salary"), "paid compensation"),
        (given("stipend"), "stipend"), (given("grant"), "grant funding"), (given("prize_money"), "prize money"),
        (covered("flights"), "flights covered"), (covered("accommodation"), "accommodation covered"),
        (covered("visa_support"), "visa support"), (covered("registration"), "registration covered"),
        (given("cloud_credits") | given("developer_credits"), "developer/cloud credits"),
        *[(F.array_contains(labels, label.lower()), signal) for label, signal in vocab.BENEFIT_SIGNALS],
    )


def judged_opportunities(opps: DataFrame) -> DataFrame:
    """Everything the judgement needs that does not depend on the profile, once per opportunity."""
    df = opps.withColumn("text", opportunity_text()).withColumn("_norm", tx.norm_alnum(F.col("text")))
    kind = tx.norm_alnum(F.col("category"))
    later = tx.ordered_flags(
        (F.contains(kind, F.lit("founder")) | F.contains(kind, F.lit("accelerator"))
         | F.coalesce(F.col("eligibility.founder_required"), F.lit(False)), "founder support"),
        (F.contains(kind, F.lit("cfp")) | F.contains(kind, F.lit("speaking")), "speaking visibility"),
        (F.contains(F.col("_norm"), F.lit("research")), "research exposure"),
        (tx.has_any(F.col("_norm"), ("training", "certification", "mentorship")), "structured learning"),
    )
    mode, funding = F.col("participation_mode"), F.col("funding")
    return df.select(
        "opportunity_key", "text", F.col("status").alias("opportunity_status"),
        tx.casefold(F.col("country")).alias("place"), frontier_term(F.col("_norm")).alias("frontier"),
        _material_signals(funding).alias("signals_before"), later.alias("signals_after"),
        feasibility(mode, funding).alias("feasibility_level"), timing(F.col("status")).alias("timing_level"),
        friction(F.col("application")).alias("friction_level"), burden_count(F.col("application")).alias("burdens"),
        confidence(F.col("extraction_confidence"), F.col("semantic_input_truncated")).alias("confidence_level"),
        concerns(mode, funding).alias("judged_concerns"),
    )


# --- per pair -----------------------------------------------------------------------

def value_level(signals: Column) -> Column:
    """Level from the number of distinct signals, with three promotions."""
    has = lambda name: F.array_contains(signals, name)
    n = F.size(signals)
    rank = F.least(n, F.lit(5))
    promoted = (
        F.when(has("paid placement"), 3)
        .when(has("fully funded training") & (has("training access") | has("certification access")), 3)
        .when(has("fully funded training"), 2).otherwise(0)
    )
    levels = tx.literal(("minimal", "limited", "moderate", "strong", "very_high", "exceptional_multi_dimensional"))
    return F.get(levels, F.greatest(rank, promoted))


def _with_matches(pairs: DataFrame, judged: DataFrame, profiles: DataFrame) -> DataFrame:
    matches = mt.relevance(mt.concept_match(pairs, mt.profile_signals(profiles), judged, "text"))
    return pairs.join(matches, ["profile_id", "opportunity_key"], "left")


def _homes(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "profile_id",
        F.transform(
            F.concat("identity.nationality", F.array(F.coalesce(
                F.try_element_at("identity.residence", F.lit("country")), F.lit("")
            ))), tx.casefold,
        ).alias("homes"),
    )


def judge(pairs: DataFrame, opps: DataFrame, profiles: DataFrame) -> DataFrame:
    """The rule assessor: one judgement per pair in the shared judgement layout."""
    judged = judged_opportunities(opps)
    met = _with_matches(pairs, judged, profiles).join(_homes(profiles), "profile_id").join(judged.drop("text"), "opportunity_key")
    return judgements(met, pairs.columns)


def judgements(met: DataFrame, keep: list[str]) -> DataFrame:
    """The judgement of pairs that have met their shared concepts, homes and ``judged_opportunities``, beside the columns ``keep``."""
    df = met
    level = mt.relevance_level(F.col("strongest"), F.col("strong_count"), F.col("frontier"))
    df = df.withColumn("relevance_level", level)
    direct = F.col("relevance_level").isin("exceptional_direct_fit", "strong_direct_fit")
    found = F.col("relevance_level") == "credible_discovery"
    one = lambda test, label: F.when(test, F.array(F.lit(label))).otherwise(F.array().cast(_TEXTS))
    abroad = F.coalesce(F.col("place") != "", F.lit(False)) & ~F.array_contains("homes", F.col("place"))
    signals = F.array_distinct(F.concat(
        "signals_before", one(direct, "strong technical alignment"), "signals_after", one(abroad, "international exposure")
    ))
    df = df.withColumn("top_positive_signals", signals)
    listed = lambda values: F.array_join(values, ", ")
    fits = F.coalesce(F.size("top_concepts"), F.lit(0)) > 0
    discovery = F.when(found, F.concat(F.lit("discovery value: names "), "frontier"))
    value_reason = F.when(F.size("top_positive_signals") > 0, F.concat(F.lit("value signals: "), listed(F.col("top_positive_signals")))).otherwise(
        "no value signal was extracted"
    )
    matched = F.concat(F.lit("matched "), listed(F.col("top_concepts")), F.lit(" through "), listed(F.col("top_sources")))
    return df.select(
        *keep, "opportunity_status", "relevance_level",
        F.coalesce(F.when(fits, matched), discovery, F.lit("no profile concept occurs in the text")).alias("relevance_reason"),
        value_level(F.col("top_positive_signals")).alias("value_level"), value_reason.alias("value_reason"),
        "feasibility_level", F.concat(F.lit("logistics: "), "feasibility_level").alias("feasibility_reason"),
        "timing_level", F.concat(F.lit("status: "), "opportunity_status").alias("timing_reason"),
        "friction_level", F.concat(F.lit("application materials: "), F.col("burdens").cast("string")).alias("friction_reason"),
        "confidence_level", F.concat(F.lit("extraction confidence: "), "confidence_level").alias("confidence_reason"),
        F.when(found, "discovery").otherwise("match").alias("match_mode"),
        F.coalesce(F.when(fits, matched), F.when(found, "surfaced as a discovery, not as a direct match"),
                   F.lit("the extracted facts show no direct match")).alias("why_you"),
        F.coalesce(discovery, value_reason).alias("why_it_matters"), discovery.alias("discovery_reason"),
        "top_positive_signals", F.col("judged_concerns").alias("concerns"),
    )


def priority_for_score(total: Column) -> Column:
    chain = F
    for band, floor in vocab.BAND_FLOORS:
        chain = chain.when(total >= floor, band)
    return chain.otherwise("not_actionable")


def priority_band(total: Column, status: Column, blockers: Column, mode: Column, reason: Column) -> Column:
    """Band of a pair; NULL where a discovery does not earn its place, which is a failure."""
    stated = F.coalesce(reason != "", F.lit(False))
    return (
        F.when((F.coalesce(F.size(blockers), F.lit(0)) > 0) | (status == "not_eligible"), "not_actionable")
        .when((mode == "discovery") & (total >= 40) & stated, "discovery")
        .when(mode == "discovery", F.lit(None))
        .otherwise(priority_for_score(total))
    )


def recommended_action(status: Column, band: Column, opportunity_status: Column) -> Column:
    return (
        F.when(status == "not_eligible", "ignore")
        .when((status == "future_eligible") | (opportunity_status == "future_cycle"), "track")
        .when(
            (opportunity_status == "opening_soon") & band.isin("exceptional", "strong_match", "worth_checking"), "prepare"
        )
        .when(band == "exceptional", "apply_now").when(band.isin("strong_match", "worth_checking"), "check_now")
        .when(band == "discovery", "save").otherwise("ignore")
    )


_DIMENSIONS = {
    "eligibility": ("eligibility_status", "eligibility_reason", vocab.ELIGIBILITY_SCORES),
    "relevance": ("relevance_level", "relevance_reason", vocab.RELEVANCE_SCORES),
    "value": ("value_level", "value_reason", vocab.VALUE_SCORES),
    "feasibility": ("feasibility_level", "feasibility_reason", vocab.FEASIBILITY_SCORES),
    "timing": ("timing_level", "timing_reason", vocab.TIMING_SCORES),
    "friction": ("friction_level", "friction_reason", vocab.FRICTION_SCORES),
    "confidence": ("confidence_level", "confidence_reason", vocab.CONFIDENCE_SCORES),
}


def with_scores(df: DataFrame) -> DataFrame:
    """Adds the seven ``{score, maximum, reason}`` structs and total_score."""
    structs = {
        f"{name}_score": F.struct(
            score_of(F.col(level), table).alias("score"), F.lit(vocab.SCORE_MAXIMA[name]).alias("maximum"),
            F.col(reason).alias("reason"),
        )
        for name, (level, reason, table) in _DIMENSIONS.items()
    }
    df = df.withColumns(structs)
    return df.withColumn("total_score", sum((F.col(f"{name}.score") for name in structs), F.lit(0)))


def score_violations() -> Column:
    """Why a row's scores cannot stand, NULL when they can."""
    odd = F.lit(False)
    for name in _DIMENSIONS:
        s = F.col(f"{name}_score")
        odd = odd | s["score"].isNull() | (s["score"] < 0) | (s["score"] > s["maximum"])
    direct = F.col("relevance_level").isin("exceptional_direct_fit", "strong_direct_fit")
    return (
        F.when((F.col("match_mode") == "discovery") & direct, "a discovery cannot claim direct relevance")
        .when(odd, "a score is outside its range")
        .when(~F.col("total_score").between(0, 100), "total score is outside 0 to 100")
        .when(F.col("priority_band").isNull(), "the discovery rule is not met")
    )


def assess(pairs: DataFrame, opps: DataFrame, profiles: DataFrame, as_of: Column, assessor=judge):
    """Assessments and failures; ``assessor`` is any (pairs, opps, profiles) -> judgement table.

    With this module's, pairs meet all of their profile while they are narrow, then all of the opportunity, where decision and
    judgement are made side by side. Only their outcome is shuffled, so that it is not made again for each of its uses. What
    another assessor returns is held to the contract; its breaches are failures of their pairs.
    """
    keys, rules, facts = ["profile_id", "opportunity_key"], mt.opportunity_rules(opps), mt.profile_facts(profiles, as_of)
    if assessor is judge:
        judged, refused = judged_opportunities(opps), None
        met = _with_matches(pairs, judged, profiles).join(facts, "profile_id").join(_homes(profiles), "profile_id")
        met = met.join(rules, "opportunity_key").join(judged.drop("text"), "opportunity_key")
        decided = mt.decided(met, met.columns)
        df = judgements(decided, [c for c in decided.columns if c in pairs.columns or c not in met.columns])
    else:
        judged, refused = ct.checked_judgements(assessor(pairs, opps, profiles), pairs)
        judged = judged.join(opps.select("opportunity_key", F.col("status").alias("opportunity_status")), "opportunity_key")
        extra = [c for c in judged.columns if c not in pairs.columns or c in keys]
        df = mt.eligibility(pairs, rules, facts).join(judged.select(*extra), keys)
    df = with_scores(df)
    df = df.withColumn("priority_band", priority_band(
        F.col("total_score"), F.col("eligibility_status"), F.col("hard_blockers"), F.col("match_mode"), F.col("discovery_reason")
    ))
    df = df.withColumn("failure", tx.hold(score_violations())).hint("rebalance", "opportunity_key")
    good = df.where(F.col("failure").isNull()).select(
        *pairs.columns, "opportunity_status", "eligibility_status", "eligibility_confidence", "eligibility_reason",
        "hard_blockers", "uncertainties", F.col("profile_evidence").alias("supporting_profile_evidence"),
        *[f"{name}_score" for name in _DIMENSIONS], "total_score", "priority_band", "match_mode", "why_you",
        F.coalesce("discovery_reason", "why_it_matters").alias("why_it_matters"), "top_positive_signals",
        F.concat("concerns", "uncertainties").alias("concerns"),
        recommended_action(F.col("eligibility_status"), F.col("priority_band"), F.col("opportunity_status")).alias("recommended_action"),
    )
    failed = df.where(F.col("failure").isNotNull()).select(
        *keys, F.lit("evaluate").alias("stage"), F.col("failure").alias("reason")
    )
    return good, failed if refused is None else failed.unionByName(refused)
