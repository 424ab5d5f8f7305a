"""Column layouts shared by the jobs, and value checks on closed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_S, _B, _I, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
_SS, _II = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMPONENT = _struct(status=_S, amount=_S, notes=_S)
EVIDENCE = _struct(field=_S, value=_S, source_url=_S, confidence=_S, evidence_text=_S)
OVERRIDE = _struct(field=_S, previous_value=_S, override_value=_S, source_file=_S)
ELIGIBILITY = _struct(
    raw_text=_S, requirements_complete=_B, nationalities_allowed=_SS, nationalities_excluded=_SS,
    regions_allowed=_SS, residence_requirements=_SS, minimum_age=_I, minimum_age_exclusive=_B, maximum_age=_I,
    maximum_age_exclusive=_B, student_required=_B, undergraduate_eligible=_B, graduate_eligible=_B,
    graduation_years=_II, minimum_university_year=_I, required_fields_of_study=_SS,
    minimum_years_experience=_D, required_skills=_SS, preferred_skills=_SS, gender_requirements=_SS,
    language_requirements=_SS, founder_required=_B, startup_stage_requirements=_SS,
    geographic_restrictions=_SS, other_requirements=_SS,
)
FUNDING = _struct(
    paid=_B, salary=_S, stipend=_S, grant=_S, prize_money=_S, honorarium=_S, flights=COMPONENT,
    accommodation=COMPONENT, visa_support=COMPONENT, visa_fees=COMPONENT, meals=COMPONENT,
    local_transport=COMPONENT, registration=COMPONENT, cloud_credits=_S, developer_credits=_S, other_benefits=_SS,
)
APPLICATION = _struct(
    application_fee=_B, fee_amount=_S, fee_waiver_available=_B, cv_required=_B, cover_letter_required=_B,
    transcript_required=_B, essays=_SS, recommendation_letters=_I, portfolio_required=_B, github_required=_B,
    video_required=_B, technical_assessment=_B, coding_challenge=_B, proposal_required=_B, pitch_deck_required=_B,
    nomination_required=_B, other_requirements=_SS,
)
DIAGNOSTICS = _struct(
    material_fields_found=_SS, material_fields_unknown=_SS, enrichment_attempted=_B, primary_source_url=_S,
    enrichment_source_url=_S, conflicts=_SS, warnings=_SS,
)
OPPORTUNITY = _struct(
    opportunity_key=_S, seq=T.LongType(), title=_S, organization=_S, category=_S, subcategories=_SS,
    program_family=_S, cycle_label=_S, cycle_year=_I, source_url=_S, official_url=_S, application_url=_S,
    status=_S, country=_S, city=_S, region=_S, participation_mode=_S, geographic_restrictions=_SS,
    opening_date=T.DateType(), deadline=T.TimestampType(), deadline_timezone=_S, program_start_date=T.DateType(),
    program_end_date=T.DateType(), rolling_application=_B, summary=_S, eligibility=ELIGIBILITY, funding=FUNDING,
    application=APPLICATION, evidence=T.ArrayType(EVIDENCE), discovered_at=T.TimestampType(),
    last_verified_at=T.TimestampType(), extraction_confidence=_S, semantic_input_truncated=_B,
    semantic_input_character_count=_I, semantic_input_limit=_I, manual_overrides=T.ArrayType(OVERRIDE),
    extraction_diagnostics=DIAGNOSTICS,
)
PAGE = _struct(
    requested_url=_S, final_url=_S, raw_html=_S, status_code=_I, content_type=_S, page_title=_S,
    fetched_at=T.TimestampType(), byte_count=_I, character_count=_I,
    redirect_history=T.ArrayType(_struct(url=_S, status_code=_I)), response_headers=T.MapType(_S, _S),
    cleaned_text=_S,
)
SOURCE = _struct(
    id=_S, name=_S, url=_S, source_type=_S, enabled=_B, category_focus=_SS, check_frequency=_S,
    max_links_per_run=_I, notes=_S,
)
SEARCH_RESULT = _struct(title=_S, url=_S, snippet=_S, rank=_I, query=_S, provider=_S)
_EXPERIENCE = _struct(organization=_S, role=_S, start_date=_S, end_date=_S, evidence=_SS, domains=_SS)
_PROJECT = _struct(name=_S, role=_S, description=_S, evidence=_SS, domains=_SS)
PROFILE = _struct(
    profile_id=_S, profile_version=_S,
    identity=_struct(
        nationality=_SS, age=_struct(current=_I, birthday=T.MapType(_S, _I)), residence=T.MapType(_S, _S),
        languages=_SS, gender=_S,
    ),
    education=_struct(
        university=_S, degree=_S, start_year=_I, graduation_year=_I,
        current_stage=_struct(year=_I, trimester=_I, description=_S), year_2_start_date=T.DateType(),
    ),
    professional_identity=_struct(primary=_SS, secondary=_SS, adjacent=_SS, discovery=_SS),
    experience=T.ArrayType(_EXPERIENCE), projects=T.ArrayType(_PROJECT),
)
#: What any assessor must return for one (opportunity, profile) pair.
JUDGEMENT = _struct(
    relevance_level=_S, relevance_reason=_S, value_level=_S, value_reason=_S, feasibility_level=_S,
    feasibility_reason=_S, timing_level=_S, timing_reason=_S, friction_level=_S, friction_reason=_S,
    confidence_level=_S, confidence_reason=_S, match_mode=_S, why_you=_S, why_it_matters=_S, discovery_reason=_S,
    top_positive_signals=_SS, concerns=_SS,
)
#: What any fact provider must return for one page (M4); nested parts as in OPPORTUNITY.
EXTRACTION_RESULT = T.StructType([
    field for field in OPPORTUNITY.fields
    if field.name in (
        "title", "organization", "category", "subcategories", "official_url", "application_url", "country", "city",
        "region", "participation_mode", "geographic_restrictions", "opening_date", "deadline", "deadline_timezone",
        "program_start_date", "program_end_date", "rolling_application", "summary", "eligibility", "funding",
        "application", "evidence", "extraction_confidence",
    )
] + [
    T.StructField("confirmed_accepting_applications", _B), T.StructField("confirmed_opening_soon", _B),
    T.StructField("confirmed_future_cycle", _B),
])
_FALSE_BY_DEFAULT = {
    "minimum_age_exclusive", "maximum_age_exclusive", "semantic_input_truncated", "enrichment_attempted",
}
_TEXT_DEFAULTS = {"category": "Unknown", "status": "unknown", "participation_mode": "unknown",
                  "extraction_confidence": "medium"}


def _default_sql(field: T.StructField) -> str:
    kind = field.dataType
    if isinstance(kind, T.ArrayType):
        return f"cast(array() as {kind.simpleString()})"
    if isinstance(kind, T.StructType):
        return "named_struct(" + ", ".join(f"'{f.name}', {_default_sql(f)}" for f in kind.fields) + ")"
    if field.name in _FALSE_BY_DEFAULT:
        return "false"
    if field.name in _TEXT_DEFAULTS:
        return f"'{_TEXT_DEFAULTS[field.name]}'"
    return f"cast(null as {kind.simpleString()})"


def default_value(field: T.StructField) -> Column:
    """Unknown in the field's own terms: NULL, empty list, unknown component."""
    return F.expr(_default_sql(field))


def fill(kind: T.StructType, **known: Column) -> Column:
    """A struct of the layout with the given fields set and the rest unknown."""
    stray = set(known) - set(kind.fieldNames())
    if stray:
        raise ValueError(f"not in the layout: {sorted(stray)}")
    return F.struct(*[
        (known[f.name].cast(f.dataType) if f.name in known else default_value(f)).alias(f.name) for f in kind.fields
    ])


def conform(df: DataFrame, kind: T.StructType) -> DataFrame:
    """Select the layout's columns, adding defaults for absent ones and casting the rest."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else default_value(f)).alias(f.name)
        for f in kind.fields
    ])


def value_violations(df: DataFrame, key: str, **allowed) -> DataFrame:
    """Rows ``(key, field, value)`` for known values outside their closed set."""
    checks = F.array(*[
        F.struct(F.lit(name).alias("field"), F.col(name).alias("value"), F.col(name).isin(*values).alias("ok"))
        for name, values in allowed.items()
    ])
    rows = df.select(key, F.explode(checks).alias("c"))
    return rows.where(F.col("c.value").isNotNull() & ~F.col("c.ok")).select(key, "c.field", "c.value")
