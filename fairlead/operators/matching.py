"""Profiles against opportunities over an explicit pair table: experience, signals, concepts, eligibility.

Which opportunities a profile sees comes in as ``pairs(profile_id,
opportunity_key)`` -- in the daily cycle, the hits of that profile's own search
queries and sources. Every join below is an equi join on it; nothing multiplies
all profiles by all opportunities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from fairlead import vocab
from fairlead.functions import text as tx
from fairlead.operators import geo
from fairlead.session import cut_lineage

MAX_PHRASE_WORDS = 8
#: Phrases that may be sent to every task (some 20 MB); more of them meet the n-grams in a shuffle.
SENT_PHRASES = 200_000
_JSON_TEXT = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(:?)'
_TEXTS = "array<string>"


# --- experience -----------------------------------------------------------------

def interval_union(intervals: DataFrame, key: str, start: str, end: str, as_of: Column) -> DataFrame:
    """Days covered by the union of date intervals per key; open ends and later ends stop at ``as_of``.

    Intervals are first folded to one row per (key, start), so a hot key enters
    the window with at most one row per calendar day. Touching days join up;
    intervals that start after ``as_of`` are dropped.
    """
    folded = (
        intervals.select(key, F.col(start).alias("_s"), F.least(F.coalesce(F.col(end), as_of), as_of).alias("_e"))
        .where((F.col("_s") <= as_of) & (F.col("_e") >= F.col("_s")))
        .groupBy(key, "_s").agg(F.max("_e").alias("_e"))
    )
    order = W.partitionBy(key).orderBy("_s")
    reach = F.max("_e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = folded.withColumn("_reach", reach)
    gain = F.datediff("_e", F.greatest("_s", F.coalesce(F.date_add("_reach", 1), F.col("_s")))) + 1
    opens = F.col("_reach").isNull() | (F.col("_s") > F.date_add("_reach", 1))
    return marked.groupBy(key).agg(
        F.sum(F.greatest(gain, F.lit(0))).cast("long").alias("days"), F.count_if(opens).alias("stretches"),
        F.min("_s").alias("first_day"), F.max("_e").alias("last_day"),
    )


def experience_years(profiles: DataFrame, as_of: Column) -> DataFrame:
    """Non-overlapping years of experience per profile (0 when there is none)."""
    entries = profiles.select("profile_id", F.explode("experience").alias("x")).select(
        "profile_id", F.try_to_date(F.concat("x.start_date", F.lit("-01"))).alias("s"),
        F.last_day(F.try_to_date(F.concat("x.end_date", F.lit("-01")))).alias("e"),
    )
    days = interval_union(entries, "profile_id", "s", "e", as_of)
    return profiles.select("profile_id").join(days, "profile_id", "left").select(
        "profile_id", (F.coalesce("days", F.lit(0)) / F.lit(365.2425)).alias("experience_years")
    )


# --- signals --------------------------------------------------------------------

def _alias_owner() -> Column:
    owner: dict[str, str] = {}
    for concept, aliases in vocab.CONCEPT_ALIASES.items():
        for alias in (concept, *aliases):
            owner.setdefault(alias, concept)
    return tx.literal(owner)


def canonical_term(term: Column) -> Column:
    name = tx.norm_alnum(term)
    return F.coalesce(F.try_element_at(_alias_owner(), name), name)


def json_leaves(body: Column) -> Column:
    """All text values of a JSON document at any depth, in document order."""
    quoted = F.regexp_extract_all(body, F.lit(_JSON_TEXT), F.lit(0))
    values = F.filter(quoted, lambda q: ~q.endswith(":"))
    rebuilt = F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))
    return F.coalesce(F.from_json(rebuilt, _TEXTS), F.array().cast(_TEXTS))


def _signals(terms: Column, weight: int, source) -> Column:
    terms = F.coalesce(terms, F.array().cast(_TEXTS))
    return F.transform(
        F.filter(terms, lambda t: t.isNotNull()),
        lambda t: F.struct(canonical_term(t).alias("concept"), F.lit(weight).alias("weight"), source(t).alias("source")),
    )


def profile_signals(profiles: DataFrame) -> DataFrame:
    """Weighted concept rows per profile, numbered in the order they are declared."""
    w = vocab.SIGNAL_WEIGHTS
    named = lambda prefix: (lambda t: F.concat(F.lit(prefix + ": "), t))
    empty = F.array().cast("array<struct<concept:string,weight:int,source:string>>")
    parts = [
        _signals(F.col(f"professional_identity.{area}"), w[area], named(f"professional_identity.{area}"))
        for area in ("primary", "secondary", "adjacent", "discovery")
    ]
    if "extra" in profiles.columns:
        inner = lambda key: json_leaves(F.get_json_object("extra", f"$.{key}"))
        parts.append(_signals(inner("career_scope.primary"), w["career_scope"], named("career_scope.primary")))
        parts.append(_signals(inner("technical_skills"), w["technical_skills"], named("technical_skills")))
    parts.append(F.flatten(F.transform("experience", lambda x: _signals(
        F.concat(F.array(x["role"]), F.coalesce(x["domains"], F.array().cast(_TEXTS))), w["experience"],
        lambda t: F.concat(F.lit("experience at "), x["organization"], F.lit(": "), t),
    ))))
    parts.append(F.flatten(F.transform("projects", lambda x: _signals(
        F.concat(F.array(x["name"]), F.coalesce(x["domains"], F.array().cast(_TEXTS))), w["project"],
        lambda t: F.concat(F.lit("project "), x["name"], F.lit(": "), t),
    ))))
    if "extra" in profiles.columns:
        for key in vocab.OPEN_SIGNAL_KEYS:
            short = F.filter(inner(key), lambda t: F.length(t) <= 80)
            parts.append(_signals(short, w[key], named(key)))
    merged = F.concat(*[F.coalesce(part, empty) for part in parts])
    rows = profiles.select("profile_id", F.posexplode(merged).alias("signal_no", "s"))
    return rows.select("profile_id", "signal_no", "s.concept", "s.weight", "s.source").where(F.col("concept") != "")


# --- concepts in texts ------------------------------------------------------------

def concept_phrases(concepts: DataFrame) -> DataFrame:
    """``(concept, phrase)``: a concept's aliases, or the concept itself."""
    aliases = tx.literal(vocab.CONCEPT_ALIASES)
    listed = F.coalesce(F.try_element_at(aliases, F.col("concept")), F.array("concept"))
    return concepts.select("concept").distinct().select("concept", F.explode(listed).alias("phrase"))


def text_concepts(texts: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct ``(key, concept)`` where a phrase occurs as whole words in the text.

    Texts become the distinct word n-grams no longer than the longest phrase and
    meet the phrases in an equi join; a phrase longer than eight words meets on
    its first eight and is then looked up in full. Phrases are settled first: up
    to ``SENT_PHRASES`` of them go to every task, so that n-grams are not shuffled.
    """
    words = F.split("phrase", " ")
    keyed = cut_lineage(phrases.select(
        "concept", "phrase", F.array_join(F.slice(words, 1, MAX_PHRASE_WORDS), " ").alias("gram"),
        F.least(F.size(words), F.lit(MAX_PHRASE_WORDS)).alias("n"), (F.size(words) > MAX_PHRASE_WORDS).alias("long"),
    ))
    count, longest, some_long = keyed.agg(F.count(F.lit(1)), F.max("n"), F.max("long")).first()
    if count <= SENT_PHRASES:
        keyed = F.broadcast(keyed)
    # n-grams are many times a text, so making them does not follow the splits that texts were read in
    tokens = texts.select(key, text).repartition(key, text).select(key, F.split(tx.norm_alnum(F.col(text)), " ").alias("_1"))
    levels = range(2, (longest or 1) + 1)
    for n in levels:
        size = F.greatest(F.size("_1") - (n - 1), F.lit(0))
        longer = F.zip_with(F.slice(f"_{n - 1}", F.lit(1), size), F.slice("_1", F.lit(n), size), lambda gram, word: F.concat(gram, F.lit(" "), word))
        tokens = tokens.withColumn(f"_{n}", longer)
    grams = F.concat("_1", *[f"_{n}" for n in levels])
    hits = tokens.select(key, F.explode(grams if count <= SENT_PHRASES else F.array_distinct(grams)).alias("gram")).join(keyed, "gram")
    short = hits.where(~F.col("long")).select(key, "concept")
    if not some_long:
        return short.distinct()
    spaced = F.concat(F.lit(" "), tx.norm_alnum(F.col(text)), F.lit(" "))
    long = hits.where("long").join(texts.select(key, spaced.alias("_t")), key).where(
        F.contains(F.col("_t"), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    ).select(key, "concept")
    return short.unionByName(long).distinct()


def best_signals(signals: DataFrame) -> DataFrame:
    """Heaviest signal per (profile, concept); the first declared wins ties."""
    best = F.max_by(F.struct("weight", "source"), F.struct("weight", -F.col("signal_no")))
    return signals.groupBy("profile_id", "concept").agg(best.alias("b")).select(
        "profile_id", "concept", "b.weight", "b.source"
    )


def concept_match(pairs: DataFrame, signals: DataFrame, texts: DataFrame, text: str = "text") -> DataFrame:
    """``(profile_id, opportunity_key, concept, weight, source)`` for the concepts a pair shares."""
    found = text_concepts(texts, concept_phrases(signals), "opportunity_key", text)
    return pairs.join(found, "opportunity_key").join(best_signals(signals), ["profile_id", "concept"])


def relevance(matches: DataFrame) -> DataFrame:
    """Strongest weight, count of strong concepts and the three leading concepts per pair."""
    # a pair's matches are bounded by the distinct phrases of one page
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "concept", "source")))
    grouped = matches.groupBy("profile_id", "opportunity_key").agg(
        F.max("weight").alias("strongest"), F.count_if(F.col("weight") >= 3).alias("strong_count"),
        F.slice(ordered, 1, 3).alias("top"),
    )
    return grouped.select(
        "profile_id", "opportunity_key", "strongest", "strong_count",
        F.transform("top", lambda t: t["concept"]).alias("top_concepts"),
        F.transform("top", lambda t: t["source"]).alias("top_sources"),
    )


def relevance_level(strongest: Column, strong_count: Column, frontier_term: Column) -> Column:
    """Level of a pair; a pair with no real fit is credited when the text names a frontier term."""
    strongest, strong = F.coalesce(strongest, F.lit(0)), F.coalesce(strong_count, F.lit(0))
    return (
        F.when((strongest >= 4) & (strong >= 2), "exceptional_direct_fit")
        .when(strongest >= 4, "strong_direct_fit")
        .when(strongest >= 2, "moderate_adjacent_fit")
        .when(frontier_term.isNotNull(), "credible_discovery")
        .otherwise("little_meaningful_fit")
    )


# --- eligibility --------------------------------------------------------------------

#: What the checks read of an opportunity's requirements; nothing else of them travels to its pairs.
_NEEDED = (
    "nationalities_allowed", "regions_allowed", "residence_requirements", "minimum_age", "minimum_age_exclusive", "maximum_age", "maximum_age_exclusive",
    "language_requirements", "student_required", "undergraduate_eligible", "graduation_years", "minimum_university_year", "minimum_years_experience",
    "other_requirements", "requirements_complete",
)


def opportunity_rules(opps: DataFrame) -> DataFrame:
    """The requirement side of eligibility, prepared once per opportunity."""
    e = F.col("eligibility")
    folded = lambda values: F.transform(values, tx.norm_ws)
    return opps.select(
        "opportunity_key", F.struct(*[e[name].alias(name) for name in _NEEDED]).alias("need"),
        geo.admitted_places(e["nationalities_allowed"]).alias("need_nationality"),
        folded(e["nationalities_excluded"]).alias("need_not"),
        geo.admitted_places(e["regions_allowed"]).alias("need_region"),
        geo.admitted_places(e["residence_requirements"]).alias("need_residence"),
        geo.admitted_places(F.concat("geographic_restrictions", e["geographic_restrictions"])).alias("need_place"),
        folded(e["gender_requirements"]).alias("need_gender"),
        F.coalesce("extraction_diagnostics.conflicts", F.array().cast(_TEXTS)).alias("conflicts"),
    )


def profile_facts(profiles: DataFrame, as_of: Column) -> DataFrame:
    """The applicant side of eligibility, prepared once per profile."""
    base = profiles.select(
        "profile_id", F.col("identity.nationality").alias("nationality"),
        F.try_element_at("identity.residence", F.lit("country")).alias("residence"),
        F.col("identity.age.current").alias("age"),
        tx.blank_to_null(F.col("identity.gender")).alias("gender"),
        F.transform(F.coalesce("identity.languages", F.array().cast(_TEXTS)), tx.norm_ws).alias("languages"),
        F.col("education.current_stage.year").alias("study_year"), F.col("education.university").alias("university"),
        F.col("education.degree").alias("degree"), F.col("education.graduation_year").alias("graduation_year"),
        F.col("education.year_2_start_date").alias("second_year_from"),
    )
    base = base.select(
        "*", geo.places(F.col("nationality")).alias("from_places"),
        geo.places(F.array("residence")).alias("home_places"),
        F.transform("nationality", tx.norm_ws).alias("nationality_text"),
        tx.norm_ws(F.col("degree")).rlike("bsc|bachelor").alias("undergraduate"),
    )
    return base.join(experience_years(profiles, as_of), "profile_id")


def _short_number(value: Column) -> Column:
    return F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))


def eligibility(pairs: DataFrame, rules: DataFrame, facts: DataFrame) -> DataFrame:
    """Decision per pair: status, confidence, reason, blockers, uncertainties, profile evidence.

    Pairs are narrow when they meet their profile and stay where the opportunity's rules join them.
    """
    return decided(pairs.join(facts, "profile_id").join(rules, "opportunity_key"), pairs.columns)


def decided(met: DataFrame, keep: list[str]) -> DataFrame:
    """The decision on pairs that have met ``profile_facts`` and ``opportunity_rules``, beside the columns ``keep``.

    Fourteen checks; every one that applies adds a blocker, an uncertainty, a
    later change or a piece of evidence.
    """
    df, c, need = met, F.col, F.col("need")
    some = lambda values: F.size(values) > 0
    lit = F.lit
    excluded = F.filter("nationality", lambda n: F.array_contains(c("need_not"), tx.norm_ws(n)))
    missing = F.filter(need["language_requirements"], lambda l: ~F.array_contains(c("languages"), tx.norm_ws(l)))
    located = F.array_distinct(F.concat("from_places", "home_places"))
    min_age, max_age = need["minimum_age"], need["maximum_age"]
    low = F.when(need["minimum_age_exclusive"], c("age") <= min_age).otherwise(c("age") < min_age)
    high = F.when(need["maximum_age_exclusive"], c("age") >= max_age).otherwise(c("age") > max_age)
    student = c("study_year") >= 1
    in_years = F.array_contains(need["graduation_years"], c("graduation_year"))
    wanted_year = need["minimum_university_year"]
    years_short = c("study_year") < wanted_year
    later = years_short & (wanted_year == 2) & c("second_year_from").isNotNull()
    wanted_experience = need["minimum_years_experience"]
    inexperienced = c("experience_years") < wanted_experience
    years = F.format_string("%.1f", c("experience_years"))
    joined = lambda values: F.array_join(values, ", ")
    under = need["undergraduate_eligible"]

    # (applies, [(condition, kind, text)])
    checks = [
        (some(need["nationalities_allowed"]), [
            (~geo.admits(c("need_nationality"), c("from_places")), "block", lit("nationality is not among those allowed")),
            (lit(True), "evidence", F.concat(lit("nationality: "), joined(c("nationality")))),
        ]),
        (some(c("need_not")), [
            (some(excluded), "block", F.concat(lit("nationality is excluded: "), joined(excluded))),
        ]),
        (some(need["regions_allowed"]), [
            (~geo.admits(c("need_region"), c("from_places")), "block", lit("nationality is outside the allowed regions")),
            (lit(True), "evidence", F.concat(lit("nationality within "), joined(need["regions_allowed"]))),
        ]),
        (some(need["residence_requirements"]), [
            (F.coalesce(c("residence"), lit("")) == "", "doubt", lit("residence is not in the profile")),
            (~geo.admits(c("need_residence"), c("home_places")), "block", F.concat(lit("residence not accepted: "), c("residence"))),
            (lit(True), "evidence", F.concat(lit("residence: "), c("residence"))),
        ]),
        (min_age.isNotNull(), [
            (low, "block", F.concat(lit("younger than required: "), c("age").cast("string"), lit(" against "), min_age.cast("string"))),
            (lit(True), "evidence", F.concat(lit("old enough: "), c("age").cast("string"))),
        ]),
        (max_age.isNotNull(), [
            (high, "block", F.concat(lit("older than allowed: "), c("age").cast("string"), lit(" against "), max_age.cast("string"))),
            (lit(True), "evidence", F.concat(lit("young enough: "), c("age").cast("string"))),
        ]),
        (some(c("need_gender")), [
            (c("gender").isNull(), "doubt", lit("gender is required and not in the profile")),
            (~F.array_contains(c("need_gender"), tx.norm_ws(c("gender"))), "block", lit("gender requirement is not met")),
            (lit(True), "evidence", F.concat(lit("gender: "), c("gender"))),
        ]),
        (some(need["language_requirements"]), [
            (some(missing), "block", F.concat(lit("missing languages: "), joined(missing))),
            (lit(True), "evidence", F.concat(lit("languages: "), joined(c("languages")))),
        ]),
        (need["student_required"].isNotNull(), [
            (need["student_required"] & ~student, "block", lit("must be a current student")),
            (need["student_required"], "evidence", F.concat(lit("student at "), c("university"))),
        ]),
        (under.isNotNull(), [
            (~under & c("undergraduate"), "block", lit("undergraduates may not apply")),
            (under & ~c("undergraduate"), "block", lit("must be an undergraduate")),
            (under, "evidence", F.concat(lit("undergraduate degree: "), c("degree"))),
        ]),
        (some(need["graduation_years"]), [
            (~in_years, "block", F.concat(
                lit("graduation year "), c("graduation_year").cast("string"), lit(" is not in "),
                joined(need["graduation_years"].cast(_TEXTS)),
            )),
            (lit(True), "evidence", F.concat(lit("graduation year: "), c("graduation_year").cast("string"))),
        ]),
        (wanted_year.isNotNull(), [
            (~years_short, "evidence", F.concat(lit("in university year "), c("study_year").cast("string"))),
            (later, "later", F.concat(lit("university year is reached on "), c("second_year_from").cast("string"))),
            (lit(True), "block", F.concat(lit("needs university year "), wanted_year.cast("string"))),
        ]),
        (wanted_experience.isNotNull(), [
            (inexperienced, "block", F.concat(lit("needs years of experience: "), _short_number(wanted_experience), lit(", has "), years)),
            (lit(True), "evidence", F.concat(lit("years of experience: "), years)),
        ]),
        (some(c("need_place")), [
            (~geo.admits(c("need_place"), located), "block", lit("neither nationality nor residence is within the geographic limits")),
            (lit(True), "evidence", lit("within the geographic limits")),
        ]),
    ]
    note = "struct<kind:string,note:string>"
    outcomes, applied = [], lit(0)
    for applies, cases in checks:
        applies = F.coalesce(applies, lit(False))
        applied = applied + applies.cast("int")
        chain = None
        for condition, kind, message in cases:
            entry = F.struct(lit(kind).alias("kind"), message.alias("note"))
            test = applies & F.coalesce(condition, lit(False))
            chain = F.when(test, entry) if chain is None else chain.when(test, entry)
        outcomes.append(chain.cast(note))
    df = df.select(
        *keep, "conflicts", need["other_requirements"].alias("_other"),
        need["requirements_complete"].alias("_complete"), applied.alias("checks_applied"),
        F.array_compact(F.array(*outcomes)).alias("_outcomes"),
    )
    of = lambda kind: F.transform(F.filter("_outcomes", lambda o: o["kind"] == kind), lambda o: o["note"])
    df = df.select(
        *keep, "checks_applied", "_other", "_complete", of("block").alias("hard_blockers"),
        of("later").alias("_later"), of("evidence").alias("profile_evidence"),
        F.concat(of("doubt"), F.transform("conflicts", lambda x: F.concat(lit("sources disagree, verify: "), x))).alias("_doubts"),
    )
    empty = F.array().cast(_TEXTS)
    status = (
        F.when(some(c("hard_blockers")), "not_eligible")
        .when(some(c("_later")), "future_eligible")
        .when(some(c("_doubts")) | some(c("_other")) | (c("checks_applied") == 0), "needs_verification")
        .when(~F.coalesce(c("_complete"), lit(False)), "likely_eligible")
        .otherwise("eligible")
    )
    df = df.withColumn("eligibility_status", status)
    uncertain = (
        F.when(c("eligibility_status") == "not_eligible", c("_doubts"))
        .when(c("eligibility_status") == "future_eligible", F.concat("_doubts", "_later"))
        .when(c("eligibility_status") == "needs_verification", F.concat(
            "_doubts", "_other",
            F.when(c("checks_applied") == 0, F.array(lit("no eligibility requirement could be verified"))).otherwise(empty),
        )).otherwise(empty)
    )
    df = df.withColumn("uncertainties", uncertain)
    reason = (
        F.when(c("eligibility_status") == "not_eligible", F.get("hard_blockers", lit(0)))
        .when(c("eligibility_status") == "future_eligible", F.get("_later", lit(0)))
        .when(c("eligibility_status") == "needs_verification", F.get("uncertainties", lit(0)))
        .when(c("eligibility_status") == "likely_eligible", "known requirements are met; the published list may be incomplete")
        .otherwise("every published requirement is met")
    )
    confidence = (
        F.when(c("eligibility_status").isin("not_eligible", "eligible"), "high")
        .when(c("eligibility_status") == "needs_verification", "low").otherwise("medium")
    )
    return df.select(
        *keep, "eligibility_status", confidence.alias("eligibility_confidence"),
        reason.alias("eligibility_reason"), "hard_blockers", "uncertainties", "profile_evidence", "checks_applied",
    )
