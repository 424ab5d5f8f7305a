"""The discovery run, the search run and the daily cycle over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fairlead.functions import urls
from fairlead.operators import (
    assess as av, classify as cl, digest as dg, discover as ds, facts as fx, history as hs, notify as nt, pages as pg, reports as rp,
    search as sr,
)
from fairlead.plans import evaluate as ev
from fairlead.session import cut_lineage
from fairlead.sources import sinks

STATE_FIELDS = list(hs.MEANINGFUL_FIELDS)


def track(opps: DataFrame, seen_at: Column, state: DataFrame | None = None) -> DataFrame:
    """Records with history key, fingerprint and change class against the stored state."""
    keyed = opps.withColumn("history_key", hs.history_key()).withColumn("seen_at", seen_at)
    keyed = keyed.withColumn("fingerprint", hs.fingerprint(hs.snapshot(keyed)))
    # raw text never makes a change, so it is set aside for the comparison
    comparable = keyed.withColumn("_raw", F.col("eligibility.raw_text")).withColumn(
        "eligibility", F.col("eligibility").dropFields("raw_text")
    )
    if state is None:
        tracked = hs.change_track(comparable, "history_key", "seq", STATE_FIELDS)
    else:
        tracked = hs.track_against(state, comparable, "history_key", "seq", STATE_FIELDS)
    return tracked


def record_key(final_url: Column) -> Column:
    """The key of the record that a page gives."""
    return F.sha2(urls.canonical_url(final_url), 256)


def discovery_run(sources: DataFrame, features: DataFrame, pairs_of: DataFrame, profiles: DataFrame, as_of: Column,
                  seen_at: Column, state: DataFrame | None = None, known_sources: DataFrame | None = None,
                  max_pages: int | None = None, assessor=av.judge) -> dict[str, DataFrame]:
    """Trusted sources to tracked records.

    ``pairs_of``: (run_id, profile_id) -- whose run it is. Pages come from the
    loaded page features; nothing is fetched twice.
    """
    candidates, failures = ds.discover(sources, features, max_pages)
    wanted = ds.specific_urls(candidates, "run_id")
    found = wanted.join(pg.aliases(features).withColumnRenamed("alias", "url"), "url")  # a page answers to each of its URLs
    opps, rejects = fx.extract(pg.latest_snapshot(features).join(found.select("final_url").distinct(), "final_url", "left_semi"))
    opps = cut_lineage(opps)
    pairs = found.join(pairs_of, "run_id").select("profile_id", record_key(F.col("final_url")).alias("opportunity_key")).distinct()
    result = ev.evaluate(opps, pairs, profiles, as_of, assessor)
    pages_at = pg.aliases(features).select(F.col("alias").alias("canonical"), urls.canonical_url(F.col("final_url")).alias("_page"))
    walked = candidates.withColumn("canonical", urls.canonical_url(F.col("url"))).join(pages_at, "canonical", "left")
    walked = walked.withColumn("canonical", F.coalesce("_page", "canonical"))
    mapped = sr.originating(result["opportunities"], walked, [], "source_id", "seq", last=True)
    unmapped = mapped.where(F.col("source_id").isNull()).select(
        F.lit("persistence").alias("stage"), F.col("source_url").alias("url"), F.lit("no source explains this record").alias("reason")
    )
    result["tracked"] = track(mapped.where(F.col("source_id").isNotNull()), seen_at, state)
    result["candidates"] = candidates
    result["failures"] = rp.failures_union(failures, rp.source_stage(rejects.select("url", "stage", "reason")), result["failures"], unmapped)
    fresh = sources.select("id", "name", "url", "source_type", "enabled", "category_focus", "check_frequency", "max_links_per_run", "notes") \
        if {"check_frequency", "notes"} <= set(sources.columns) else sources.select("id", "url")
    result["sources"] = sinks.upsert_sources(known_sources, fresh, seen_at) if known_sources is not None else fresh
    return result


def search_run(profiles: DataFrame, recorded: DataFrame, features: DataFrame, as_of: Column, seen_at: Column,
               state: DataFrame | None = None, max_queries: int | None = None, max_results: int | None = None,
               cap: int | None = None, fetch_cap: int | None = None, assessor=av.judge) -> dict[str, DataFrame]:
    """Query plan, recorded hits, merged candidates, page shapes, assessments and tracked records.

    Each profile is its own run. ``recorded``: hits (title, url, snippet, rank,
    query, provider, seq).
    """
    queries = sr.query_plan(profiles, F.to_date(seen_at), max_queries).withColumnRenamed("text", "query")
    hits = sr.replay(recorded, queries, max_results).withColumn("canonical", urls.canonical_url(F.col("url")))
    arrival = F.col("query_no").cast("long") * 1_000_000 + F.col("rank")
    scored = sr.score_hits(hits.withColumn("seq", arrival).withColumnRenamed("mode", "query_mode"))
    capped = sr.arrival_cap(scored.where(F.col("search_score") >= 0), "profile_id", "canonical", "seq", cap)
    candidates, provenance = sr.merge_hits(capped, ["profile_id", "canonical"])
    chosen = cut_lineage(sr.fetch_list(candidates, "profile_id", fetch_cap))
    found = chosen.join(pg.aliases(features).withColumnRenamed("alias", "canonical"), "canonical")
    wanted = pg.latest_snapshot(features).join(found.select("final_url").distinct(), "final_url", "left_semi")
    opps, rejects = fx.extract(wanted)
    opps = cut_lineage(opps)
    pairs = found.select("profile_id", record_key(F.col("final_url")).alias("opportunity_key")).distinct()
    result = ev.evaluate(opps, pairs, profiles, as_of, assessor)
    names = found.select("canonical", "final_url").distinct()
    refused = rejects.join(names.join(wanted.select("final_url", F.col("requested_url").alias("url")), "final_url"), "url").select("canonical", "reason")
    result["queries"], result["provenance"] = queries, provenance
    result["candidates"] = sr.observe_shapes(chosen, cl.with_page_shape(wanted.drop("canonical")).join(names, "final_url"), refused)
    left_out = candidates.join(chosen.select("profile_id", "canonical"), ["profile_id", "canonical"], "left_anti")
    beyond = scored.where(F.col("search_score") >= 0).join(candidates.select("profile_id", "canonical"), ["profile_id", "canonical"], "left_anti")
    capped_rows = left_out.select("url", "provider").unionByName(beyond.select("url", "provider")).distinct().select(
        F.lit("capped").alias("stage"), "url", "provider", F.lit("hit is beyond the caps of the run").alias("reason")
    )
    missing = chosen.join(names.select("canonical").distinct(), "canonical", "left_anti").select(
        F.lit("candidate_fetch").alias("stage"), "url", "provider", F.lit("page is not among the loaded pages").alias("reason")
    )
    result["tracked"] = track(result["opportunities"], seen_at, state)
    result["failures"] = rp.failures_union(missing, capped_rows, rp.search_stage(rejects.select("url", "stage", "reason")), result["failures"])
    result["sources"] = sr.virtual_sources(candidates)
    return result


def persisted(result: dict[str, DataFrame], state: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a run leaves for the next one: new versions of records and the state that it will be tracked against."""
    tracked = result["tracked"]
    return {"versions": hs.versions(tracked), "state": hs.next_state(tracked, "history_key", "seq", STATE_FIELDS, state)}


def merge_items(*runs: dict[str, DataFrame]) -> DataFrame:
    """Assessed and tracked records of several runs, one item per profile and history key."""
    merged = None
    for number, result in enumerate(runs):
        changes = result["tracked"].select("opportunity_key", "history_key", "fingerprint", "change_class", "changed_fields")
        items = result["assessments"].join(changes, "opportunity_key").withColumn("_run", F.lit(number))
        merged = items if merged is None else merged.unionByName(items, allowMissingColumns=True)
    merged = merged.withColumn("item_id", F.sha2("history_key", 256))
    return hs.precedence_merge(merged.withColumn("_at", F.struct("_run", "seq")), ["profile_id", "item_id"], "_at").drop("_at", "_run")


def daily_cycle(items: DataFrame, ledger: DataFrame, runs: DataFrame, work: dict[str, DataFrame] | None = None,
                fetch_cap: int | None = None) -> dict[str, DataFrame]:
    """Summary, plans, outbox and heartbeats of one day; sending is somebody else's job.

    ``work``: the day's sources, queries, candidates and failures by profile_id; with them the summary has all ten measures.
    """
    planned = nt.notify_plan(items, ledger)
    header, lines = nt.outbox(planned)
    beats = nt.heartbeat(runs, planned.select("profile_id").distinct(), "profile_id")
    return {
        "summary": rp.daily_summary(items, "profile_id") if work is None else rp.run_summary(
            runs, items, work["sources"], work["queries"], work["candidates"], work["failures"], fetch_cap, "profile_id"
        ), "plans": planned, "outbox": header, "outbox_items": lines,
        "heartbeats": beats, "sections": dg.change_sections(items, only_changed=True),
    }
