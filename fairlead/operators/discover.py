"""Bounded two-hop discovery from trusted sources, as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fairlead.operators import classify as cl, ordered, pages as pg
from fairlead.functions import urls
from fairlead.session import cut_lineage

SKIPPED = ("navigation", "non_opportunity", "organization_page")


def capped_frontier(candidates: DataFrame, run: str, source: str, seq: str, max_links: str, max_pages: int | None = None) -> DataFrame:
    """Candidates that get loaded: each source's first ``max_links`` (NULL: all), then the run's first ``max_pages`` (None: all), in order."""
    place = F.row_number().over(Window.partitionBy(run, source).orderBy(seq))
    allowed = candidates.withColumn("_n", place).where(F.col(max_links).isNull() | (F.col("_n") <= F.col(max_links))).drop("_n")
    return allowed if max_pages is None else ordered.top_k(allowed, [run], [F.col(seq)], max_pages, "_n").drop("_n")


def settle_visits(candidates: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Which candidates are recorded and visited when sources are walked in order, depth first.

    ``candidates`` holds every link that could be met: run_id, source_no, seq
    (struct compared in walking order), depth, parent_seq (the hub link a
    depth-2 link came through), url, eligible, loadable, is_hub, max_links,
    pinned (recorded even when its URL was seen).

    Whether a link counts depends only on links before it (seen already, caps
    used up, hub visited), so repeating the whole-table decision settles from
    the front and stops at the one consistent answer -- the answer of walking
    link by link. Each round is joins and windows; lineage is cut per round.
    """
    candidates = cut_lineage(candidates)
    hubs = candidates.where((F.col("depth") == 1) & F.col("is_hub") & F.col("eligible") & F.col("loadable"))
    visited_hubs = hubs.select("run_id", F.col("seq").alias("parent_seq")).limit(0)
    before = 0
    decided = None
    while True:  # each round settles at least the next link in order
        open_hubs = visited_hubs.withColumn("_open", F.lit(True))
        active = candidates.join(open_hubs, ["run_id", "parent_seq"], "left").where(
            (F.col("depth") == 1) | F.col("_open")
        ).drop("_open")
        owner = active.groupBy("run_id", "url").agg(F.min("seq").alias("_owner"))
        recorded = active.join(owner, ["run_id", "url"]).where(
            F.col("pinned") | (F.col("seq") == F.col("_owner"))
        ).drop("_owner")
        recorded = cut_lineage(recorded)
        loads = recorded.where(F.col("eligible") & F.col("loadable"))
        visited = cut_lineage(capped_frontier(loads, "run_id", "source_no", "seq", "max_links", max_pages))
        now = visited.where((F.col("depth") == 1) & F.col("is_hub")).select("run_id", F.col("seq").alias("parent_seq"))
        changed = now.join(visited_hubs, ["run_id", "parent_seq"], "left_anti").limit(1).count() + (
            visited_hubs.join(now, ["run_id", "parent_seq"], "left_anti").limit(1).count() if before else 0
        )
        decided = recorded.join(
            visited.select("run_id", "seq", F.lit(True).alias("visited")), ["run_id", "seq"], "left"
        ).withColumn("visited", F.coalesce("visited", F.lit(False)))
        if not changed:
            return decided
        visited_hubs, before = now, 1


def link_candidates(features: DataFrame, depth: int, *keep: str) -> DataFrame:
    """Scored and classified links of pages that carry source columns (source_url, category_focus)."""
    found = pg.links(features, *keep, "source_url", "category_focus")
    return cl.classify_links(cl.score_links(found)).withColumn("depth", F.lit(depth))


def discover(sources: DataFrame, features: DataFrame, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Discovery candidates (with final class and visit mark) and failures.

    ``sources``: run_id, source_no (walking order), id, url, source_type,
    category_focus, max_links_per_run, name, notes, enabled. ``features``: the
    page features of every page that could be loaded; a page is found by its
    requested, final or own canonical URL, and its newest snapshot counts.
    Without ``max_pages`` and a source's ``max_links_per_run`` nothing is cut;
    every page that a cap leaves out is a failure row of stage ``capped``.
    """
    sources = sources.where("enabled").select(
        "run_id", "source_no", F.col("id").alias("source_id"), F.col("url").alias("source_url"), "source_type",
        "category_focus", F.col("max_links_per_run").alias("max_links"), "name", "notes",
        urls.canonical_url(F.col("url")).alias("_at"),
    )
    pages = pg.by_alias(features).select(
        F.col("alias").alias("_at"), "final_url", "nodes", "canonical", cl.visit_title(F.col("nodes"), F.col("page_title")).alias("_title"),
    )
    located = sources.join(pages, "_at", "left")
    failures = located.where(F.col("final_url").isNull()).select(
        "run_id", F.lit("source_fetch").alias("stage"), "source_id", F.col("source_url").alias("url"),
        F.lit("source page is not among the loaded pages").alias("reason"),
    )
    loaded = located.where(F.col("final_url").isNotNull())
    keep = ("run_id", "source_no", "source_id", "max_links")
    no_hub = F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(-1).alias("c"))
    walk = lambda a, b, c: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), c.cast("int").alias("c"))
    fixed = loaded.where(F.col("source_type") == "recurring_programme").select(
        *keep, walk(F.col("source_no"), F.lit(-1), F.lit(-1)).alias("seq"), no_hub.alias("parent_seq"),
        F.col("canonical").alias("url"), F.col("source_url").alias("discovered_from_url"), F.col("name").alias("anchor_text"),
        F.coalesce("notes", F.lit("Configured recurring programme")).alias("nearby_context"), F.lit(6).alias("score"),
        F.array(F.lit("configured recurring programme")).alias("signals"), F.lit("specific_opportunity").alias("link_class"),
        F.lit(1).alias("depth"),
    )
    walked = loaded.where(F.col("source_type") != "recurring_programme")
    first = link_candidates(walked, 1, *keep)
    failures = failures.unionByName(
        walked.join(first.select("run_id", "source_no").distinct(), ["run_id", "source_no"], "left_anti").select(
            "run_id", F.lit("no_candidates").alias("stage"), "source_id", F.col("source_url").alias("url"),
            F.lit("source page has no web links").alias("reason"),
        )
    )
    shaped = lambda df, seq, parent: df.select(
        *keep, seq.alias("seq"), parent.alias("parent_seq"), F.col("canonical").alias("url"),
        F.col("final_url").alias("discovered_from_url"), F.col("label").alias("anchor_text"),
        F.col("context").alias("nearby_context"), F.col("link_score").alias("score"), F.col("link_signals").alias("signals"),
        "link_class", "depth", "source_url", "category_focus",
    )
    depth1 = shaped(first, walk(F.col("source_no"), F.col("pos"), F.lit(-1)), no_hub)
    targets = pages.select(F.col("_at").alias("url"), "final_url", "nodes", "canonical", "_title")

    def visit(links: DataFrame) -> DataFrame:
        eligible = (F.col("score") >= 3) & ~F.col("link_class").isin(*SKIPPED)
        joined = links.withColumn("eligible", eligible).join(targets, "url", "left")
        return joined.withColumn("loadable", F.col("nodes").isNotNull()).withColumn(
            "visited_class", F.when(F.col("loadable") & eligible, cl.visited_class(F.col("nodes"), F.col("_title"), F.col("score")))
        ).withColumn("is_hub", F.coalesce(F.col("visited_class") == "opportunity_hub", F.lit(False)))

    one = visit(depth1)
    hub_pages = one.where("is_hub").withColumnRenamed("seq", "hub_seq").select(
        *keep, "hub_seq", "source_url", "category_focus", "final_url", "nodes"
    )
    second = link_candidates(hub_pages, 2, *keep, "hub_seq")
    depth2 = shaped(second, walk(F.col("hub_seq.a"), F.col("hub_seq.b"), F.col("pos")), F.col("hub_seq"))
    trim = lambda df: df.drop("nodes", "final_url", "_title", "source_url", "category_focus")
    links = trim(one).unionByName(trim(visit(depth2))).withColumn("pinned", F.lit(False))
    everything = links.unionByName(
        fixed.withColumns({
            "pinned": F.lit(True), "eligible": F.lit(False), "loadable": F.lit(True), "visited_class": F.lit(None).cast("string"),
            "is_hub": F.lit(False), "canonical": F.col("url"),
        })
    )
    decided = settle_visits(everything, max_pages)
    candidates = decided.withColumn(
        "classification", F.when(F.col("visited"), F.col("visited_class")).otherwise(F.col("link_class"))
    ).withColumn("url", F.when(F.col("visited"), F.col("canonical")).otherwise(F.col("url")))
    failures = failures.unionByName(
        decided.where(F.col("eligible") & ~F.col("loadable")).select(
            "run_id", F.lit("candidate_fetch").alias("stage"), "source_id", "url",
            F.lit("candidate page is not among the loaded pages").alias("reason"),
        )
    )
    left_out = decided.where(F.col("eligible") & F.col("loadable") & ~F.col("visited"))
    failures = failures.unionByName(
        left_out.select("run_id", F.lit("capped").alias("stage"), "source_id", "url", F.lit("page is beyond the caps of its source or run").alias("reason"))
    )
    return candidates.drop("eligible", "loadable", "is_hub", "visited_class", "canonical", "parent_seq", "max_links", "pinned"), failures


def specific_urls(candidates: DataFrame, *scope: str) -> DataFrame:
    """Distinct canonical URLs of candidates classed as single opportunities."""
    return candidates.where(F.col("classification") == "specific_opportunity").select(
        *scope, urls.canonical_url(F.col("url")).alias("url")
    ).distinct()


