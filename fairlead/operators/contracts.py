"""What a foreign fact provider or assessor must return, checked row by row; every breach is a failure row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fairlead import schemas, vocab
from fairlead.functions import text as tx, urls
from fairlead.operators import classify as cl, facts as fx, pages as pg
from fairlead.session import cut_lineage

#: What a page gives to a provider, and what comes back beside it.
_ASKED = ("page_key", "requested_url", "final_url", "fetched_at", "page_text", "character_count", "truncated")
_ANSWER = T.StructType([T.StructField("result", schemas.EXTRACTION_RESULT), T.StructField("error", T.StringType())])
_URL = r"(?i)https?://[^\s)\]>\"']+"


# --- fact provider ------------------------------------------------------------------

def _fitted(found: dict, kinds: dict[str, pa.DataType], layout: pa.StructType) -> dict:
    """The stated fields of an answer, tried one by one against the layout; an error names what does not fit."""
    if type(found) is not dict:
        return pa.array([found], layout).to_pylist()[0]
    try:
        for name, value in found.items():
            if value is not None and not (type(value) is str and kinds[name] == pa.string()):
                pa.array([value], kinds[name])
    except (pa.ArrowException, TypeError, ValueError, OverflowError):
        return pa.array([found], layout).to_pylist()[0]  # the layout's own words for it
    return found


def _results(rows: list[dict | None], layout: pa.StructType) -> pa.Array:
    """Answers as one Arrow array, field by field; fields that no answer states cost nothing a row."""
    stated = {name for row in rows if row for name in row}
    columns = []
    for field in layout:
        if field.name not in stated:
            columns.append(pa.nulls(len(rows), field.type))
            continue
        values = [None if row is None else row.get(field.name) for row in rows]
        try:
            columns.append(pa.array(values, field.type))
        except (pa.ArrowException, TypeError, ValueError, OverflowError):  # records told in several ways
            columns.append(pa.concat_arrays([pa.array([v], field.type) for v in values]))
    return pa.StructArray.from_arrays(columns, fields=list(layout), mask=pa.array([row is None for row in rows], pa.bool_()))


def answers(asked: DataFrame, provider: Callable[[str, str], dict]) -> DataFrame:
    """``asked`` with ``result`` and ``error``: ``provider(page_text, page_url)`` returns a result's fields as a dict.

    An exception of the provider, or an answer outside the layout, is the error of its page alone.
    """
    schema = T.StructType([*asked.schema.fields, *_ANSWER.fields])
    layout = to_arrow_schema(T.StructType([_ANSWER["result"]])).field(0).type
    kinds = {f.name: f.type for f in layout}
    names = [*asked.columns, "result", "error"]
    at_text, at_url = names.index("page_text"), names.index("final_url")

    def one(text: str, url: str) -> tuple[dict | None, str | None]:
        try:
            found = provider(text, url)
        except Exception as error:  # noqa: BLE001 - whatever a provider raises is the failure of this page
            return None, f"provider: {error or type(error).__name__}"
        try:
            if set(found) - kinds.keys():
                raise ValueError(f"unknown fields {sorted(set(found) - kinds.keys())}")
            return _fitted(found, kinds, layout), None
        except (pa.ArrowException, TypeError, ValueError, OverflowError) as error:
            return None, f"response: {str(error).splitlines()[0]}"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t.as_py(), u.as_py()) for t, u in zip(batch.column(at_text), batch.column(at_url), strict=True)]
            columns = [*batch.columns, _results([r for r, _ in found], layout), pa.array([e for _, e in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.mapInArrow(body, schema)


def _allowed() -> Column:
    """The URLs a page is known by or mentions."""
    mentioned = F.regexp_extract_all("page_text", F.lit(_URL), F.lit(0))
    return F.concat(F.array(urls.canonical_url(F.col("requested_url")), urls.canonical_url(F.col("final_url"))), F.transform(mentioned, urls.canonical_url))


def _breach() -> Column:
    """Why an answer cannot stand, NULL when it can; the first reason counts."""
    r = F.col("result")
    at_home = lambda url: F.array_contains("_allowed", urls.canonical_url(urls.resolve_url(F.col("final_url"), url)))
    stray = lambda url: url.isNotNull() & ~F.coalesce(at_home(url), F.lit(False))
    shown = F.coalesce(r["evidence"], F.array().cast(T.ArrayType(schemas.EVIDENCE)))
    snippet = lambda e: tx.norm_ws(F.coalesce(e["evidence_text"], F.lit("")))
    outside = lambda value, allowed: value.isNotNull() & ~value.isin(*allowed)
    return (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.coalesce(F.trim(r["title"]), F.lit("")) == "", "response: no title")
        .when(outside(r["participation_mode"], vocab.PARTICIPATION_MODES), "response: unknown participation mode")
        .when(outside(r["extraction_confidence"], vocab.CONFIDENCE_LEVELS), "response: unknown confidence")
        .when(F.exists(shown, lambda e: e["field"].isNull() | e["value"].isNull()), "response: evidence without field or value")
        .when(F.exists(shown, lambda e: outside(e["confidence"], vocab.CONFIDENCE_LEVELS)), "response: unknown confidence")
        .when(F.exists(shown, lambda e: (snippet(e) == "") | ~F.contains(F.col("_flat"), snippet(e))), "ungrounded: evidence is not on the page")
        .when(F.exists(shown, lambda e: stray(e["source_url"])) | stray(r["official_url"]) | stray(r["application_url"]), "ungrounded: a URL is not on the page")
    )


def provided_facts(pages: DataFrame, provider: Callable[[str, str], dict], ask=answers) -> tuple[DataFrame, DataFrame]:
    """Records in the opportunity layout, and failures ``(page_key, stage, reason)``, of pages read by any provider.

    ``pages``: page_key, requested_url, final_url, cleaned_text, fetched_at. Texts are bounded before the provider sees them.
    Its answer must keep to the layout, show evidence that stands on the page, name only URLs of the page, and leave no material
    fact without evidence; the status is derived, never taken from it. The provider runs once, on pages dealt evenly to tasks: its answers are checkpointed.
    ``ask`` may be another way to run it (for a batch model) that returns the same columns.
    """
    bounded = pg.bound_text(pages, "cleaned_text").withColumnRenamed("analysis_text", "page_text")
    short = bounded.where(F.col("reject_kind").isNotNull() | F.col("character_count").isNull())
    failed = [short.select("page_key", F.lit("extract").alias("stage"), F.coalesce("reject_kind", F.lit("insufficient_cleaned_content")).alias("reason"))]
    enough = bounded.where(F.col("reject_kind").isNull() & F.col("character_count").isNotNull())
    # a provider takes far longer than reading a page, so its pages do not follow the splits they were read in
    asked = enough.select(*_ASKED).repartition("page_key", "final_url", "page_text")
    known = ask(asked, provider).withColumns({"_flat": tx.hold(tx.norm_ws(F.col("page_text"))), "_allowed": tx.hold(_allowed())})
    judged = cut_lineage(known.withColumn("_breach", _breach()).drop("_flat", "_allowed"))
    failed.append(judged.where(F.col("_breach").isNotNull()).select("page_key", F.lit("extract").alias("stage"), F.col("_breach").alias("reason")))
    kept = judged.where(F.col("_breach").isNull())
    r = F.col("result")
    status = cl.derive_status(
        r["deadline"], r["opening_date"], F.col("fetched_at"), r["rolling_application"], r["confirmed_accepting_applications"],
        r["confirmed_opening_soon"], r["confirmed_future_cycle"],
    )
    shared = [f.name for f in schemas.EXTRACTION_RESULT.fields if f.name in schemas.OPPORTUNITY.fieldNames() and f.name not in ("title", "evidence")]
    stated = {n: F.coalesce(r[n], schemas.default_value(schemas.OPPORTUNITY[n])) for n in shared}
    evidence = F.transform(
        F.coalesce(r["evidence"], F.array().cast(T.ArrayType(schemas.EVIDENCE))),
        lambda e: F.struct(
            e["field"].alias("field"), e["value"].alias("value"),
            urls.resolve_url(F.col("final_url"), F.coalesce(e["source_url"], "final_url")).alias("source_url"),
            F.coalesce(e["confidence"], F.lit("medium")).alias("confidence"), F.trim(e["evidence_text"]).alias("evidence_text"),
        ),
    )
    record = schemas.fill(
        schemas.OPPORTUNITY, **stated, opportunity_key=F.col("page_key").cast("string"), title=F.trim(r["title"]), status=status, evidence=evidence,
        source_url=F.col("requested_url"), discovered_at=F.col("fetched_at"), last_verified_at=F.col("fetched_at"),
        semantic_input_truncated=F.col("truncated"), semantic_input_character_count=F.col("character_count"), semantic_input_limit=F.lit(vocab.MAX_ANALYSIS_CHARS),
    )
    records = kept.select(record.alias("o")).select("o.*")
    bare = fx.evidence_violations(records).groupBy("opportunity_key").agg(F.min("fact").alias("fact"))
    unproven = bare.join(kept.select("page_key", F.col("page_key").cast("string").alias("opportunity_key")), "opportunity_key")
    failed.append(unproven.select("page_key", F.lit("extract").alias("stage"), F.concat(F.lit("unproven: "), "fact").alias("reason")))
    good = records.join(bare.select("opportunity_key"), "opportunity_key", "left_anti").select(*schemas.OPPORTUNITY.fieldNames())
    return good, failed[0].unionByName(failed[1]).unionByName(failed[2])


# --- judgement ----------------------------------------------------------------------

_LEVELS = {
    "relevance": vocab.RELEVANCE_SCORES, "value": vocab.VALUE_SCORES, "feasibility": vocab.FEASIBILITY_SCORES,
    "timing": vocab.TIMING_SCORES, "friction": vocab.FRICTION_SCORES, "confidence": vocab.CONFIDENCE_SCORES,
}


def judgement_breach(copies: Column) -> Column:
    """Why a judgement does not keep its contract, NULL when it does; the first reason counts."""
    level = lambda name: F.coalesce(F.col(f"{name}_level").isin(*_LEVELS[name]), F.lit(False))
    blank = lambda name: F.coalesce(F.trim(F.col(name)), F.lit("")) == ""
    holes = lambda name: F.coalesce(F.exists(name, lambda x: x.isNull()), F.lit(False))
    reason = F.when(copies > 1, "more than one judgement for a pair")
    for name in _LEVELS:
        reason = reason.when(~level(name), f"{name}_level is not a level").when(blank(f"{name}_reason"), f"{name}_reason is missing")
    return (
        reason.when(~F.coalesce(F.col("match_mode").isin(*vocab.MATCH_MODES), F.lit(False)), "match_mode is not a mode")
        .when(blank("why_you"), "why_you is missing").when(blank("why_it_matters"), "why_it_matters is missing")
        .when(holes("top_positive_signals") | holes("concerns"), "a list holds nulls")
    )


def checked_judgements(judged: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgements that keep the contract, and failures ``(profile_id, opportunity_key, stage, reason)``.

    A field that an assessor leaves out counts as NULL, NULL lists are empty, further columns are not carried. Pairs without a
    judgement fail, judgements of other pairs are left out, and all judgements of a pair that has several fail as one.
    """
    keys = ["profile_id", "opportunity_key"]
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.JUDGEMENT.fields if f.name not in judged.columns]
    present = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.JUDGEMENT.fields if f.name in judged.columns]
    rows = judged.select(*keys, *present, *absent)
    fields = schemas.JUDGEMENT.fieldNames()
    asked = pairs.select(*keys).distinct()
    one = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fields)).alias("_j"))
    found = asked.join(one, keys, "left").select(*keys, "_n", "_j.*")
    missing = F.when(F.col("_n").isNull(), F.lit("no judgement")).otherwise(judgement_breach(F.col("_n")))
    told = found.withColumn("reason", tx.hold(missing))
    lists = {n: F.coalesce(n, F.array().cast("array<string>")) for n in ("top_positive_signals", "concerns")}
    good = told.where(F.col("reason").isNull()).select(*keys, *fields).withColumns(lists)
    failed = told.where(F.col("reason").isNotNull()).select(*keys, F.lit("evaluate").alias("stage"), "reason")
    return good, failed
